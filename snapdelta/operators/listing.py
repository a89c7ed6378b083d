"""Listings of declarations: descriptors, one side alone, lists with a limit of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import qualified_name


def descriptors(nodes: DataFrame, side: str) -> DataFrame:
    """(id, kind, name, file, side, signature, span) of declarations: endpoints are called by method and path, files by their
    path; only functions show a signature. Method, path and span (start, end) are optional columns."""
    has = lambda c, kind="string": F.col(c) if c in nodes.columns else F.lit(None).cast(kind)
    name = qualified_name(F.col("kind"), F.col("name"), has("method"), F.coalesce(has("path"), F.col("file")))
    span = has("span", "struct<start: long, end: long>")
    return nodes.select(name.alias("id"), "kind", name.alias("name"), "file", F.lit(side).alias("side"), F.when(F.col("kind") == "function", F.col("signature")).alias("signature"), span.alias("span"))


def one_side(document: dict[str, DataFrame], side: str, kept: tuple[str, ...] = ("nodes", "edges", "cfg", "coverage", "notices")) -> dict[str, DataFrame]:
    """The tables of an analysis as one side alone shows them: rows of the other side go, and tables of what was
    derived from both (deltas, flows, verdicts, notes) are empty, but for those named in ``kept``."""
    out = {}
    for name, df in document.items():
        own = df if name in kept else df.limit(0)
        out[name] = own.where(F.col("side") == side) if "side" in df.columns and name in kept else own
    return out


def listed(nodes: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """Rows by ``keys`` in the order head, base, then id, with their place; where there are more than ``most``, one row
    with RESULTS_TOO_LARGE and the number instead. (side, node_id, name, …)"""
    n = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = nodes.join(n.where(F.col("n") <= most).select(*keys), keys, "left_semi")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("side") != "head", "node_id"))  # at most ``most`` rows each
    fits = rows.select(*keys, "side", "node_id", "name", place.cast("long").alias("place"), F.lit(None).cast("string").alias("error"))
    none = F.lit(None)
    over = n.where(F.col("n") > most).select(*keys, none.cast("string"), none.cast("long"), none.cast("string"), F.col("n"), F.lit("RESULTS_TOO_LARGE"))
    return fits.union(over)


def spilled(nodes: DataFrame, folder: str) -> None:
    """The whole list as JSON lines, for who was told that it is too large."""
    nodes.write.mode("overwrite").json(folder)
