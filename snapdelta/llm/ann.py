"""Operator 6: nearest neighbours with randomly rotated one-bit codes.

A unit vector is rotated at random and kept as the signs of its components (D bits) with one correction
scalar, the inner product of the rotated vector with its code. From the packed bits and the rotated query the
inner product is estimated without bias, with an error bound that holds with high probability; only vectors
whose upper bound reaches the best exact scores so far are scored exactly, on the original vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

#: Vectors in a block of candidates, and queries in a block.
BLOCK, QUERIES = 8192, 1024


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, without null or non-finite components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _matrix(col: pa.Array, field: str) -> np.ndarray:
    """Vectors as rows, each scaled by a power of two: its cosines stay the same, and no square over- or underflows."""
    v = np.asarray(col.field(field).flatten(), np.float64).reshape(len(col), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])


def _pack(seed: int, as_code: bool):
    """Blocks of (id, vector) to packed columns: ids, vectors and rotated vectors, or codes and scalars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                rows = batch.column("rows").slice(i, 1).flatten()
                ids, x = np.asarray(rows.field("id"), np.int64), _matrix(rows, "v")
                by = np.argsort(ids, kind="stable")
                ids, x = ids[by], x[by]
                r = (x / np.sqrt((x * x).sum(1))[:, None]) @ rotation(x.shape[1], seed).T
                if as_code:
                    code = np.packbits(r > 0, axis=1).tobytes()
                    scalar = np.abs(r).sum(1) / np.sqrt(x.shape[1])
                else:
                    code, scalar = r.astype(np.float32).tobytes(), np.ones(len(ids))
                out.append((batch.column("d")[i].as_py(), batch.column("block")[i].as_py(), ids.tobytes(), x.tobytes(), code, scalar.tobytes()))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["d", "block", "ids", "x", "code", "scalar"])

    return run


_PACKED = "d long, block long, ids binary, x binary, code binary, scalar binary"


def _search(k: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c, t, i=i: np.frombuffer(batch.column(c)[i].as_py(), t)
                d = batch.column("d")[i].as_py()
                qid, ids = at("q_ids", np.int64), at("ids", np.int64)
                q, x = at("q_x", np.float64).reshape(-1, d), at("x", np.float64).reshape(-1, d)
                rotated = at("q_code", np.float32).reshape(-1, d)
                signs = np.unpackbits(at("code", np.uint8).reshape(len(ids), -1), axis=1, count=d).astype(np.float32) * 2 - 1
                scalar = at("scalar", np.float64).astype(np.float32)
                q_norm, x_norm = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
                bound = width * np.sqrt(np.maximum(1 - scalar**2, 0)) / scalar / np.sqrt(max(d - 1, 1))
                got = []
                for lo in range(0, len(qid), 128):
                    guess = (rotated[lo : lo + 128] @ signs.T) / (np.sqrt(d) * scalar)
                    upper = guess + bound
                    for j, (g, u) in enumerate(zip(guess, upper), lo):
                        others = ids != qid[j]
                        m = min(k, int(others.sum()))
                        if not m:
                            continue
                        g = np.where(others, g, -np.inf)
                        seed = np.argpartition(g, -m)[-m:]
                        score = lambda w, j=j: (x[w] * q[j]).sum(1) / (q_norm[j] * x_norm[w])
                        least = score(seed).min()
                        near = np.flatnonzero((u >= least) & others)
                        if len(near) < m:
                            near = np.union1d(near, seed)
                        s = score(near)
                        best = np.lexsort((ids[near], -s))[:m]
                        got.append((np.full(m, qid[j]), ids[near[best]], s[best]))
                cols = [np.concatenate(c) for c in zip(*got)] if got else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, width: float = 2.5, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest cosine found for each query, but its own id.

    Scores are exact cosines of the original vectors in double precision; equal scores go by the smaller id.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do vectors
    of null id; a query meets only vectors of its own length. Of rows repeated with one id, the one of
    the smallest vector (component by component) takes part, as query and as candidate.
    Queries are dealt in blocks against blocks of all vectors; ``width`` scales the error bound. An empty
    table gives an empty result; other columns are ignored."""

    def blocks(df: DataFrame, each: int, as_code: bool) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
        v = v.groupBy("id").agg(F.min("v").alias("v")).select(F.size("v").cast("long").alias("d"), "id", "v")
        n = max(1, -(-df.count() // each))
        packed = v.groupBy("d", F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
        return packed.mapInArrow(_pack(seed, as_code), _PACKED)

    index = materialise(blocks(vectors, BLOCK, True), "codes")
    asked = blocks(queries, QUERIES, False).select("d", *(F.col(c).alias(f"q_{c}") for c in ("block", "ids", "x", "code")))
    asked = materialise(asked, "queries")
    n = asked.agg(F.coalesce(F.max("q_block"), F.lit(0))).first()[0]
    dealt = index.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))).join(asked, ["d", "q_block"])
    width_now = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(width_now, "block", "q_block").mapInArrow(_search(k, width), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
