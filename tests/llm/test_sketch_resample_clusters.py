"""Operators 11 to 13 against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.llm import centroids, common, importance, setsketch, simjoin, token_sets
from snapdelta.llm.sql import ORACLE_SQL
from snapdelta.llm.queries import QUERIES

TABLES = "documents embeddings benchmark".split()


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op11_setsketch", "op12_importance", "op13_centroids"])
def test_rows_equal_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    df, want = QUERIES[name](spark, small), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


# ---- SetSketch ---------------------------------------------------------------------------------------------------


def some_sets(sizes, seed=1):
    rng = np.random.default_rng(seed)
    toks = [np.sort(rng.choice(1 << 40, n, replace=False).astype(np.uint64)) for n in sizes]
    return toks, token_sets.Sets(np.arange(len(sizes)), np.zeros(len(sizes)), np.array(sizes), np.arange(len(sizes)), np.concatenate(toks) if toks else np.empty(0, np.uint64))


def test_sketches_merge_and_estimate():
    pool, _ = some_sets([4000])
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.5, 0.8, 0.95):
        for size in (5, 60, 1500):
            both = round(2 * size * share / (1 + share))
            drawn = rng.permutation(pool[0])[: 2 * size - both]
            a, b = np.sort(drawn[:size]), np.sort(np.concatenate([drawn[:both], drawn[size:]]))
            union = np.union1d(a, b)
            sets = token_sets.Sets(np.arange(3), np.zeros(3), np.array([len(a), len(b), len(union)]), np.arange(3), np.concatenate([a, b, union]))
            k = setsketch.sketches(sets)
            assert (np.maximum(k[0], k[1]) == k[2]).all()  # the union's sketch is that of its parts
            more, less = (k[:1] > k[1:2]).sum(1), (k[:1] < k[1:2]).sum(1)
            best, _ = setsketch.estimate(more, less, setsketch.M - more - less, np.array([float(len(a))]), np.array([float(len(b))]))
            errors.append(abs(best[0] - both / len(union)))
    assert max(errors) < 0.15 and np.mean(errors) < 0.06


def test_each_token_gives_each_register_once():
    seed = token_sets.mix(np.arange(1, 200, dtype=np.uint64))
    seen = np.stack([setsketch._register(j, seed) for j in range(setsketch.M)])
    assert (np.sort(seen, axis=0) == np.arange(setsketch.M)[:, None]).all()


def brute(texts, k, num, den):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * (len(sets[i]) + len(sets[j]) - both) and both:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts(n=400, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts, stems = [], [[word() for _ in range(rng.choice([3, 8, 40, 200]))] for _ in range(25)]
    for i in range(n):
        w = list(rng.choice(stems)) if rng.random() < 0.9 else [word() for _ in range(rng.randrange(60))]
        for _ in range(int(len(w) * rng.choice([0, 0.01, 0.03, 0.06, 0.12]))):
            w[rng.randrange(len(w))] = word()
        texts.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return texts


@pytest.mark.parametrize("blocks", [False, True])
def test_sketch_join_against_brute_force(spark, monkeypatch, blocks):
    if blocks:  # families and keys of several blocks
        monkeypatch.setattr(simjoin, "BLOCK_SETS", 6)
        monkeypatch.setattr(setsketch, "BLOCK", 8)
        monkeypatch.setattr(setsketch, "SHORT", 3)
    texts = near_texts() + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "oNE"), (1005, "one two")]
    want = brute(texts, 2, 4, 5)
    got = setsketch.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert {r.doc_id for r in got.where("kept").collect()} == {i for i, (_, c) in want.items() if i == c}


def test_sketch_join_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert setsketch.near_duplicates(none).collect() == []
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, "w " * 200_000, "long"), (3, "w " * 199_999 + "v", "long")]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, sketch string").withColumn("sid", F.lit(1)))
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got.collect()), key=str) == [(1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (None, None, None)]


def test_pairs_are_judged_as_by_the_likeliest_similarity(monkeypatch):
    """Without a search for the peak where the registers tell already."""
    rng = np.random.default_rng(8)
    n = rng.integers(40, 400, 4000).astype(float)
    m = np.round(n * rng.uniform(0.8, 1.25, 4000))
    similar = rng.uniform(0.4, 1, 4000) * np.minimum(n / m, m / n)
    equal = rng.binomial(setsketch.M, similar)
    more = rng.binomial(setsketch.M - equal, 0.5)
    a, b = (np.zeros((4000, setsketch.M), np.uint16) for _ in "ab")
    a[np.arange(setsketch.M) < more[:, None]] = 1
    b[(np.arange(setsketch.M) >= more[:, None]) & (np.arange(setsketch.M) < setsketch.M - equal[:, None])] = 1
    fits = (n * 5 >= m * 4) & (m * 5 >= n * 4) & (equal >= setsketch.M * 0.8 - 8 * np.sqrt(setsketch.M * 0.16))
    search, searched = setsketch.estimate, []
    best, likelihood = search(more, setsketch.M - more - equal, equal, n, m)
    want = fits & ((best >= 0.8) | (likelihood(np.minimum(0.8, np.minimum(n / m, m / n))) >= likelihood(best) - setsketch.SLACK))
    monkeypatch.setattr(setsketch, "estimate", lambda *of: searched.append(len(of[0]) * (of[5:] != (0,))) or search(*of))
    assert (setsketch._plausible(a, b, n, m, 4, 5) == want).all() and 0.2 < want.mean() < 0.8
    assert sum(searched) < 0.1 * fits.sum()


def test_a_round_of_components_deals_twice(spark, monkeypatch):
    plans, write = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, *name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *name))
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 1), (3, 2), (9, 4)], "a long, b long")
    assert {tuple(r) for r in common.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (9, 4)}
    assert max(p.count("Exchange") for p in plans) == 2


def test_components_settle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    assert {tuple(r) for r in common.connected_components(chain).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


# ---- importance resampling ---------------------------------------------------------------------------------------


def test_crcs_come_from_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        words = [bytes(rng.choice(b"abz09\xc3\xa9") for _ in range(rng.choice([1, 3, 9, 300]))) for _ in range(rng.randrange(1, 30))]
        for crc, n in importance.run_crcs(words, 4):
            assert crc.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


def plain_features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_against_a_plain_version(spark, monkeypatch, longest):
    monkeypatch.setattr(importance, "_STEP", 64)  # texts come in many pieces
    rng = random.Random(6)
    words = ["Alpha", "beta7", "é", "日本", "x", "long" * 40, "a_b", "C++"]
    text = lambda n: rng.choice([" ", ", ", "\n-- "]).join(rng.choices(words, k=n))
    docs = [(i, text(rng.randrange(60))) for i in range(120)] + [(500, None), (501, ""), (502, "!!"), (None, text(40)), (503, text(30)), (503, text(30))]
    target = [(text(12),) for _ in range(8)] + [(None,)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "text string"), longest=longest, buckets=97).collect()
    s, t = np.zeros(97, int), np.zeros(97, int)
    for _, x in docs:
        np.add.at(s, [c % 97 for c in plain_features(x, longest)[0]], 1)
    for (x,) in target:
        np.add.at(t, [c % 97 for c in plain_features(x, longest)[0]], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 97) / ((a + 1) * (t.sum() + 97)))) for a, b in zip(s, t)]
    want = []
    for i, x in docs:
        f, n = plain_features(x, longest)
        weight = sum(gain[c % 97] for c in f)
        h = None if i is None else int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20 and i is not None))
    fit = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0]))
    rank = {}
    for r, w in enumerate(fit[: 10 * len(fit) // 100], 1):
        rank.setdefault(w[:4], []).append(r)
    want = sorted(((*w[:4], rank[w[:4]].pop(0) if rank.get(w[:4]) and w[4] else None) for w in want), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_resampling_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string").withColumn("weight", F.lit(7)).withColumn("id", F.lit(1))
    assert importance.resample(none, none).collect() == []
    (r,) = importance.resample(one, none, percent=100).collect()
    assert (r.n_features, r.rank) == (30, 1)


def test_ranks_run_through_all_ranges(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id")
    got = [r["rank"] for r in common.ranked(rows, "rank", F.desc("v"), F.asc("id")).orderBy(F.desc("v"), "id").collect()]
    assert got == list(range(1, 1001))
    assert common.ranked(rows.limit(0), "rank", F.desc("v")).count() == 0


# ---- centroids -----------------------------------------------------------------------------------------------------


def test_tournament_finds_the_nearest_and_the_smaller_number():
    rng = np.random.default_rng(5)
    for _ in range(50):
        c = rng.integers(-3, 4, (rng.integers(1, 9), 4))
        c = np.concatenate([c, c[:1]])  # equal centroids: the smaller number
        x = rng.integers(-4, 5, (200, 4))
        want = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        assert (centroids.tournament(x, *centroids.bisectors(c)) == want).all()


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows if x is not None and len(x) == 4 and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [x for _, x in order[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda x: min(range(len(c)), key=lambda j: (far(x, c[j]), j))
    for _ in range(rounds):
        own = [nearest(x) for _, x in kept]
        c = [[sum(x[d] for (_, x), o in zip(kept, own) if o == j) // own.count(j) for d in range(4)] if j in own else y for j, y in enumerate(c)]
    out = [(i, nearest(x), far(x, c[nearest(x)])) for i, x in kept]
    return sorted(((i, j, d, sum(e for _, l, e in out if l == j), sum(e for *_, e in out), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def test_clusters_against_a_plain_version(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 2.0]) + rng.random() / 50 for _ in range(4)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, [1.0] * 3), (None, [0.5] * 4), (5, rows[5][1]), (5, rows[5][1]), (6, [9.0] * 4)]
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
    got = centroids.clusters(frame.withColumn("cluster", F.lit("x")), k=5, rounds=6, dims=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows, 5, 6)
    few = centroids.clusters(frame.where("vec_id < 3"), k=5, rounds=6, dims=4).collect()
    assert sorted((tuple(r) for r in few), key=str) == plain_clusters(rows[:3], 5, 6)
    assert centroids.clusters(frame.limit(0), dims=4).collect() == []


def test_components_too_large_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit"):
        centroids.clusters(frame, dims=2).collect()
