"""Operators 6, 8 and 9, and the pipeline."""

import math

import numpy as np
from pyspark.sql import functions as F

from snapdelta.llm import ann, mixing, quality


def test_search_finds_exact_neighbours_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 24)).astype(np.float32)
    x[100:140] = x[100]  # ties
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, [1.0, 2.0]), (None, [1.0] * 24), (5, x[5].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(5)
    got = ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    found = total = 0
    for q in range(0, 400, 50):
        s = np.delete(y @ y[q], q)
        ids = np.delete(np.arange(400), q)
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        found, total = found + len(set(best) & set(mine)), total + 5
        if q == 100:
            assert mine == [101, 102, 103, 104, 105]
    assert found / total >= 0.95 and {r.query_id for r in got} <= set(range(0, 400, 50))
    few = ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []


def test_quality_rejects_bad_and_shrinks_sites(spark):
    rows, labels = [], []
    for i in range(300):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = "WIN!! WIN!! NOW!! " * 10 if bad else f"a calm text about matter {i % 13} and thing {i % 11}" + (" you vile fool" if toxic else "")
        rows.append((i, text, "spam" if bad else f"s{i % 3}", "en"))
        labels.append((i, 0 if bad else 1, 1 if toxic and not bad else 0))
    rows += [(1000, None, None, None), (1001, "", "s1", "en"), (1002, "a calm text about matter", "new", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, lab).collect()}
    wrong = [i for i, q, t in labels if got[i].keep == (q == 0 or t == 1)]
    assert len(wrong) <= 3 and len(got) == len(rows) and got[1002].keep
    assert all(0 < r.p_bad < 1 and 0 < r.site < 1 for r in got.values())
    spam, calm = got[0].site, got[1].site
    assert spam > calm
    assert all(r.keep for r in quality.quality(docs, lab.limit(0)).collect())
    assert quality.quality(docs.limit(0), lab).collect() == []
    assert quality.quality(docs, lab, keep_columns=True).columns[:4] == docs.columns


def test_raking_meets_targets_and_draws_by_chance(spark):
    rows = [(i, "word " * (20 + i % 50), ["a", "b", "c", None][i % 4], ["x", "y"][i % 3 % 2]) for i in range(4000)] + [(9000, None, "a", "x"), (9001, "", "b", "y"), (None, "word " * 30, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix(docs, alpha=0.3, share=0.5)
    rows_out = out.collect()
    assert len(rows_out) == len(rows)
    cells = out.groupBy(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("_topic").alias("_t")).agg(F.sum("_tokens").alias("tokens"), F.first("_weight").alias("w"))
    for d in ("_s", "_l", "_t"):
        want = mixing.shares({r[0]: r[1] for r in cells.groupBy(d).agg(F.sum("tokens")).collect()}, 0.3)
        have = {r[0]: r[1] for r in cells.groupBy(d).agg(F.sum("w")).collect()}
        assert all(math.isclose(have[k], v, abs_tol=1e-4) for k, v in want.items())
    whole = sum(r._tokens for r in rows_out)
    assert math.isclose(sum(r._tokens * r._p for r in rows_out), 0.5 * whole, rel_tol=1e-6)
    assert abs(sum(r._tokens for r in rows_out if r._take) / whole - 0.5) < 0.05
    assert not any(r._take for r in rows_out if not r.text)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_pipeline_stages_keep_the_columns_of_documents(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns and docs.schema["n_chars"].dataType == before.schema["n_chars"].dataType, name
        assert 0 < docs.count() <= before.count()
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert out.count() == docs.count() and "ids" in out.columns
