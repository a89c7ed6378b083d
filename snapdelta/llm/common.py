"""Shared pieces of the training-data operators: reliable materialisation, ranks, connected components, a Bloom filter."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .token_sets import mix

#: Size of a Bloom filter. Beyond its reach it lets more rows pass; none is lost.
FILTER_BITS = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which a cluster names in spark.checkpoint.dir. Only a local master may leave
    it unset (tests, a laptop): then a folder under the warehouse is used."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), "_shared")
    return named.rstrip("/")


def free_name(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores before it as it takes to clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with each row's place in ``order``, from 1. Rows are dealt out by ranges of the order and written; a range
    is numbered by itself, and only the sizes of the ranges (one row a partition) are summed up in one place."""
    width = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    part, before = (free_name(c, df.columns) for c in ("range_no", "range_before"))
    dealt = materialise(df.repartitionByRange(width, *order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}
    offset, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, offset))
        offset += sizes[p]
    starts = df.sparkSession.createDataFrame(starts, f"{part} int, {before} long")
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(name, place).join(F.broadcast(starts), part).withColumn(name, F.col(name) + F.col(before)).drop(part, before)


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node of the component. Alternating large-star and
    small-star rounds; each is two windows over the neighbours of a node, and is written to the shared folder.
    Null ends and self loops are ignored; an empty table gives an empty result."""
    e = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    )
    of = Window.partitionBy("u")
    again = F.coalesce(F.lag("v").over(of.orderBy("v")) == F.col("v"), F.lit(False)).alias("again")  # an edge that came twice
    for _ in range(max_rounds):
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = e.select(F.inline(ends)).select("u", "v", again, F.least(F.min("v").over(of), "u").alias("m"))
        big = both.where("not again and v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the edge to the smallest neighbour stays, the others go on from there
        small = big.select("u", "v", again, F.min("v").over(of).alias("m")).where("not again")
        e = materialise(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), "cc")
        # done where all are stars: each node has one edge, and no centre has one
        none = F.lit(None).cast(e.schema["v"].dataType)
        ends = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("to")), F.struct(F.col("v").alias("x"), none.alias("to")))
        to = e.select(F.inline(ends))
        to = to.groupBy("x").agg(F.min("to").alias("low"), F.max("to").alias("top"), F.max(F.col("to").isNull()).alias("centre"))
        if not to.where("low <> top or (centre and low is not null)").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("label")), F.struct(F.col("v").alias("node"), F.col("v").alias("label"))))).distinct()


def bloom_slots(ids: np.ndarray, units: np.ndarray | None = None) -> np.ndarray:
    """Two bits of the filter for each id, or for each id and unit."""
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    if units is not None:
        h = mix(h + mix(units.astype(np.uint64) + np.uint64(1)))
    return np.stack([h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)]).astype(np.int64)


def passes_bloom(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((words[slots >> 5] >> (slots & 31).astype(np.uint32)) & 1).all(axis=0)


def bloom_filter(rows: DataFrame, *columns: str) -> np.ndarray:
    """A Bloom filter of fixed size over an id column, and over the id and a unit column if that is given too; in
    words of 32 bits."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in columns]
            bit = np.unique(np.concatenate([bloom_slots(*cols[: i + 1]).ravel() for i in range(len(cols))]))
            word, at = bit >> 5, bit & 31
            edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word[edge]), pa.array(np.add.reduceat(1 << at, edge) if len(edge) else edge)], ["word", "bits"])

    found = rows.select(*columns).mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 32, np.uint32)
    words[found.word.to_numpy(np.int64)] = found.bits.to_numpy(np.int64).astype(np.uint32)
    return words
