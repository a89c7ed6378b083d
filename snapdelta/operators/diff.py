"""Keyed comparison of two snapshots. Ids differ between snapshots, so rows meet on natural keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: of duplicates the one of the highest ``order`` (the last wins)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    return best.select(*keys, *(F.col("_v")[c].alias(c) for c in rest))


def keyed_diff(base: DataFrame, head: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join on the keys; each value as before_/after_, and status added, removed, changed, unchanged."""
    b = base.select(*keys, *(F.col(v).alias(f"before_{v}") for v in values), F.lit(True).alias("_b"))
    h = head.select(*keys, *(F.col(v).alias(f"after_{v}") for v in values), F.lit(True).alias("_h"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"before_{v}").eqNullSafe(F.col(f"after_{v}"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return b.join(h, keys, "full").withColumn("status", status).drop("_b", "_h")


def row_delta(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is on one side only, with ``change``. A bag difference: rows of one key all stay."""
    added = head.join(base.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("added"))
    removed = base.join(head.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def row_classes(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Head rows new or persistent, base rows resolved."""
    old, now = base.select(*keys).distinct(), head.select(*keys).distinct()
    return (
        head.join(old, keys, "left_anti").withColumn("class", F.lit("new"))
        .unionByName(base.join(now, keys, "left_anti").withColumn("class", F.lit("resolved")))
        .unionByName(head.join(old, keys, "left_semi").withColumn("class", F.lit("persistent")))
    )


def compared_runs(base: DataFrame, head: DataFrame, keys: list[str], runs: DataFrame, key: str = "analysis") -> DataFrame:
    """``row_classes`` of each analysis by itself, where ``runs`` (key, side, ok) says that both sides ran: a side that
    failed tells nothing, so neither are its errors resolved nor the others new."""
    both = runs.where("ok").groupBy(key).agg(F.countDistinct("side").alias("n")).where("n = 2").select(key)
    return row_classes(*(df.join(both, key, "left_semi") for df in (base, head)), [key, *keys])


def set_delta(base: DataFrame, head: DataFrame, keys: list[str], items: str) -> DataFrame:
    """Array columns compared by key: ``added`` and ``removed`` items in order of declaration; rows that differ."""
    none = F.array().cast("array<string>")
    both = base.select(*keys, F.col(items).alias("_b")).join(head.select(*keys, F.col(items).alias("_h")), keys, "full")
    b, h = F.coalesce("_b", none), F.coalesce("_h", none)
    return both.select(*keys, F.array_except(h, b).alias("added"), F.array_except(b, h).alias("removed"), F.col("_b").isNotNull().alias("in_base"), F.col("_h").isNotNull().alias("in_head")).where("size(added) > 0 or size(removed) > 0")


def renamed(delta: DataFrame) -> DataFrame:
    """Exactly one item added and one removed is a rename: both lists are cleared."""
    one = (F.size("added") == 1) & (F.size("removed") == 1)
    none = F.array().cast("array<string>")
    return delta.select(
        *[c for c in delta.columns if c not in ("added", "removed")],
        F.when(one, none).otherwise(F.array_sort("added")).alias("added"),
        F.when(one, none).otherwise(F.array_sort("removed")).alias("removed"),
        F.when(one, F.element_at("removed", 1)).alias("renamed_from"), F.when(one, F.element_at("added", 1)).alias("renamed_to"),
    )


def paired(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Pair the k-th row of each key on the left with the k-th on the right (first come, first served);
    what is left over stays unpaired. Columns other than keys must differ in name."""
    l_ = left.withColumn("pair", F.row_number().over(W.partitionBy(*keys).orderBy(*left_order)))
    r_ = right.withColumn("pair", F.row_number().over(W.partitionBy(*keys).orderBy(*right_order)))
    return l_.join(r_, [*keys, "pair"], "full")
