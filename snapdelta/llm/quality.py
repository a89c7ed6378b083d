"""Operator 8: document quality by a classifier and by the site it comes from (hierarchical empirical Bayes).

Two classifier heads (low quality, toxic) over telling words and text shapes give each document's evidence.
Evidence is summed by host and by path; a host's rate is shrunk toward the global rate, a path's toward its
host's, each with a strength estimated from the spread between sites. The posterior of a document is its own
evidence moved by the odds of its site."""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialise

#: Up to so many sites are broadcast.
MOST_SENT = 200_000
_SYMBOLS = re.compile(r"[^\w\s]{2,}")


class _Shapes(dict):
    """Words to (word without punctuation in lower case, loud, full of symbols, without a letter or digit)."""

    def __missing__(self, w: str) -> tuple[str, bool, bool, bool]:
        if len(self) >= 1 << 17:
            self.clear()
        got = self[w] = (w.strip(".,;:!?\"'()").lower(), w.isupper(), bool(_SYMBOLS.search(w)), not any(c.isalnum() for c in w))
        return got


_SHAPES = _Shapes()


def features(text: str | None) -> set[str]:
    """Words in lower case, and shapes: how varied, how loud, how full of symbols, how repetitive."""
    raw = text.split() if text else []
    n = len(raw)
    if not n:
        return {"#empty"}
    out, loud, marks, bare = set(), 0, 0, 0
    for w, c in Counter(raw).items():
        word, l_, m, b = _SHAPES[w]
        out.add(word)
        loud, marks, bare = loud + c * l_, marks + c * m, bare + c * b
    varied, tenth = len(out), lambda x: 10 * x // n
    size = "s" if n < 50 else "m" if n < 500 else "l"
    runs = sum(map(operator.eq, raw, raw[1:]))
    out.update((f"#varied{size}{tenth(varied)}", f"#loud{tenth(loud)}", f"#marks{tenth(marks)}", f"#bare{tenth(bare)}", f"#runs{tenth(runs)}"))
    return out


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_, low, toxic = Counter(), Counter(), Counter()
        for text, q, t in zip(*(batch.column(c).to_pylist() for c in ("text", "quality", "toxic"))):
            f = features(text) | {"#all"}
            all_.update(f)
            if q == 0:
                low.update(f)
            if t == 1:
                toxic.update(f)
        names = list(all_)
        cols = [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in (all_, low, toxic))]
        yield pa.RecordBatch.from_arrays(cols, ["feature", "n", "low", "toxic"])


def _chosen(names: list[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[[at[w] for w in f & at.keys()] for at in names] for f in map(features, batch.column("text").to_pylist())]
            cols = [pa.array([x[h] for x in ids], pa.list_(pa.int32())) for h in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, batch.column("quality"), batch.column("toxic")], ["low", "toxic_f", "quality", "toxic"])

    return run


def _weights(rows: list, y: np.ndarray, n: int, penalty: float, steps: int) -> np.ndarray:
    """Logistic regression on presence of features, the last weight being the constant: accelerated gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.empty(0, np.int64)
    w = v = np.zeros(n + 1)
    for _ in range(steps):
        u = w + 0.9 * v
        score = np.bincount(at, u[col], minlength=len(rows)) + u[-1]
        off = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        grad = np.append(np.bincount(col, off[at], minlength=n) + penalty * u[:-1], off.sum()) / len(y)
        v = 0.9 * v - 2.0 * grad
        w = w + v
    return w


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 10_000, most_features: int = 300, least: int = 4, z: float = 4.5, penalty: float = 0.1, steps: int = 400) -> dict:
    """Both heads, from at most ``most_rows`` labelled rows (the smallest hashes of the id; a null label counts as
    good). A head looks at no more than ``most_features`` features that occur in ``least`` of these rows and whose
    bad rates differ most, by ``z`` standard errors at least; its weights are a penalised logistic regression.
    Without labels, evidence is even and nothing is rejected."""
    sample = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("long"), F.col("toxic").cast("long")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id").select("text", "quality", "toxic")
    rows = materialise(rows, "sample")
    seen = rows.mapInArrow(_seen, "feature string, n long, low long, toxic long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "low", "toxic")))
    seen = materialise(seen, "features")
    total = seen.where("feature = '#all'").first()
    model: dict = {"prior": [], "heads": []}
    if total is None:
        return model
    names: list[dict] = []
    for head in ("low", "toxic"):
        n, bad = total["n"], total[head]
        rate = bad / n
        if not 0 < bad < n:
            names.append({})
            continue
        gap = F.abs(F.col(head) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
        telling = seen.where((F.col("feature") != "#all") & (F.col("n") >= least)).withColumn("z", gap).where(F.col("z") >= z)
        best = telling.orderBy(F.desc("z"), "feature").limit(most_features).collect()
        names.append({r["feature"]: i for i, r in enumerate(best)})
    data = rows.mapInArrow(_chosen(names), "low array<int>, toxic_f array<int>, quality long, toxic long").toPandas()
    for at, column, y in zip(names, ("low", "toxic_f"), ((data.quality == 0).to_numpy(float), (data.toxic == 1).to_numpy(float))):
        w = _weights(list(data[column]), y, len(at), penalty, steps)
        model["prior"].append(float(w[-1]))
        model["heads"].append({f: float(w[i]) for f, i in at.items()})
    return model


def evidence(model: dict, text: str | None) -> float:
    """The chance that a text is of low quality or toxic, by the classifier alone."""
    if not model["heads"]:
        return 0.5
    f, good = features(text), 1.0
    for prior, head in zip(model["prior"], model["heads"]):
        x = prior + sum(head[w] for w in f & head.keys())
        good *= 1 / (1 + math.exp(min(max(x, -30), 30)))
    return min(max(1 - good, 1e-6), 1 - 1e-6)


def _score(sent, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_evidence", pa.array([evidence(sent.value, t.as_py()) for t in batch.column(text_at)], pa.float64()))

    return run


def _strength(sites: DataFrame, mean: float) -> float:
    """How many documents the prior of a site is worth: the method of moments for a beta-binomial."""
    spread = sites.where("n > 1").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)), F.sum("n"), F.count("*")).first()
    if not spread[1] or mean <= 0 or mean >= 1:
        return 100.0
    between = spread[0] / spread[1] - mean * (1 - mean) * spread[2] / spread[1]
    return float(min(max(mean * (1 - mean) / max(between, 1e-9) - 1, 2.0), 10_000.0))


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", keep_columns: bool = False, cut: float = 0.5) -> DataFrame:
    """(id, evidence, site, p_bad, keep) for each row, or with ``keep_columns`` all columns of ``docs`` and those
    four with a leading underscore.

    ``evidence`` is the classifier's chance that the text is low or toxic, ``site`` the posterior rate of its
    path, ``p_bad`` both together; ``keep`` is p_bad < ``cut``. A null host or path is a site of its own. Null and
    empty texts have the feature of emptiness only. Without labels, or with an empty table, all is kept.
    Repeated rows are scored alike. Columns of ``docs`` that have the names of the new ones are replaced. Sites are
    sent to all tasks up to MOST_SENT of them (a few tens of MB); beyond that they are joined."""
    spark = docs.sparkSession
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    sent = spark.sparkContext.broadcast(model)
    docs = docs.drop("_evidence", "_site", "_p_bad", "_keep")
    own = docs if keep_columns else docs.select(id_col, text_col, *dict.fromkeys(c for c in (host, path) if c not in (id_col, text_col)))
    extra = T.StructField("_evidence", T.DoubleType())
    scored = own.mapInArrow(_score(sent, own.columns.index(text_col)), T.StructType([*own.schema.fields, extra]))
    scored = materialise(scored if keep_columns else scored.drop(text_col), "evidence")  # each text is scored once
    paths = scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum("_evidence").alias("s"))
    paths = materialise(paths, "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n"), F.sum("s"), F.count("*")).first()
    mean = min(max(whole[1] / whole[0], 1e-6), 1 - 1e-6) if whole[0] else 0.5
    a, b = _strength(hosts, mean), _strength(paths, mean)
    h, p, site = (free_name(x, own.columns) for x in ("host", "path", "_site"))
    rates = hosts.select(F.col("host").alias("h"), ((F.col("s") + a * mean) / (F.col("n") + a)).alias("host_rate"))
    sites = paths.join(rates, F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias(h), F.col("path").alias(p), ((F.col("s") + b * F.col("host_rate")) / (F.col("n") + b)).alias(site))
    sites = F.broadcast(sites) if paths.count() <= MOST_SENT else sites
    logit = lambda c: F.log(c / (1 - c))
    joined = scored.join(sites, scored[host].eqNullSafe(F.col(h)) & scored[path].eqNullSafe(F.col(p)), "left")
    joined = joined.withColumn("_p_bad", 1 / (1 + F.exp(-(logit(F.col("_evidence")) + logit(F.col("_site")) - math.log(mean / (1 - mean))))))
    joined = joined.withColumn("_keep", F.lit(True) if not model["heads"] else F.col("_p_bad") < cut)
    if keep_columns:
        return joined.select(*(scored[c] for c in docs.columns), "_evidence", "_site", "_p_bad", "_keep")
    return joined.select(id_col, F.col("_evidence").alias("evidence"), F.col("_site").alias("site"), F.col("_p_bad").alias("p_bad"), F.col("_keep").alias("keep"))
