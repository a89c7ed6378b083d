"""Operator 10: document fingerprints by winnowing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

#: Words of a gram, and grams of a window: any run of GRAM + WINDOW - 1 words that two texts share is found.
GRAM, WINDOW = 5, 16
#: Rows of one bucket, about, when the next document is looked up, and groups of buckets.
BUCKET, GROUPS = 64, 1024
#: Up to so many bucket heads are broadcast (16 bytes each).
HEADS = 1 << 20


def winnow(df: DataFrame, text_col: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``df`` with column ``out``: the chosen grams of ``text_col`` in order of position, each as one long,
    hash * 2^32 + (2^32 - 1 - position of its first word).

    Words are runs of other than white space in lower case, cut after 16 characters (so that text without
    spaces has words too). Each window of grams gives its least hash, the rightmost of equal ones: of these
    longs just the least. A text of fewer words is one gram; a null, empty or blank one has none. The steps
    are columns of their own, so that a lambda reads an array instead of making it again."""
    df = df.withColumn("_words", F.transform(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"(\S{1,16})"), F.lit(1)), lambda w: F.xxhash64(w)))

    def packed(h, i):
        return F.shiftleft(h.bitwiseAND(F.lit(0x7FFFFFFF)), 32) + (F.lit(0x100000000) - i)

    n = F.size("_words")
    rolled = F.transform(F.sequence(F.lit(1), n - (gram - 1)), lambda i: packed(F.xxhash64(F.slice("_words", i, gram)), i))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_grams", F.when(n >= gram, rolled).when(n > 0, F.array(packed(F.xxhash64("_words"), F.lit(1)))).otherwise(none))
    m = F.size("_grams")
    slid = F.array_distinct(F.transform(F.sequence(F.lit(1), m - (window - 1)), lambda i: F.array_min(F.slice("_grams", i, window))))
    df = df.withColumn(out, F.when(m >= window, slid).when(m > 0, F.array(F.array_min("_grams"))).otherwise(none))
    return df.drop("_words", "_grams")


def as_text(prints):
    """position:hash of each gram, joined by a comma; hashes in hexadecimal."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lit(0xFFFFFFFF) - x.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(":"), F.lower(F.hex(F.shiftright(x, 32))))), ",")


def likeness(a: str, b: str):
    """Jaccard similarity of the hashes of two fingerprints whose hashes are in these columns; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def _hashes(prints):
    return F.array_distinct(F.transform(prints, lambda x: F.shiftright(x, 32)))


def _bucketed(docs: DataFrame, id_col: str, tie: str) -> DataFrame:
    """``docs`` with _g and _b: groups of neighbouring ids, cut at quantiles, and in them buckets of about BUCKET rows,
    both in the order of ids. An id that many rows share, and a null id, is a group of its own, whose buckets go by
    ``tie``. Groups are at most about GROUPS however many rows there are and however their ids are spread."""
    i = F.col(id_col)
    spread = docs.agg(F.approx_percentile(i, [k / GROUPS for k in range(GROUPS + 1)], 10 * GROUPS)).first()[0] or [0]
    hot = {x for x, y in zip(spread, spread[1:]) if x == y}
    bounds = sorted({*spread, *(x + 1 for x in hot if x < (1 << 63) - 1)})
    step = math.isqrt(len(bounds)) + 1
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    block = F.size(F.filter(longs([x[0] for x in blocks]), lambda x: x <= i))
    within = F.size(F.filter(F.get(F.array(*map(longs, blocks)), block - 1), lambda x: x <= i))
    own = docs.withColumn("_g", F.when(i.isNull(), -1).when(block < 1, 0).otherwise(block * (step + 1) + within))
    ranges = own.groupBy("_g").agg(F.min(id_col), F.max(id_col), F.count("*")).collect()  # a row for each group
    widths = {g: max(1.0, (hi - lo) * BUCKET / n) for g, lo, hi, n in ranges if g >= 0 and lo != hi}
    width = F.try_element_at(F.create_map(*(F.lit(x) for kv in widths.items() for x in kv)), F.col("_g")) if widths else F.lit(None).cast("double")
    return own.withColumn("_w", width).withColumn("_b", F.floor(F.coalesce(i / F.col("_w"), F.col(tie) / F.lit(float(1 << 52))))).drop("_w")


def with_next(docs: DataFrame, carry: list[str], derive=lambda df: df, id_col: str = "id", tie: str = "tie") -> DataFrame:
    """``derive(docs)`` with next_<c> for each column of ``carry``: its value in the next row by descending id (ties
    by ``tie``, nulls last; after the last row comes the first). ``derive`` adds columns row by row.

    Rows are dealt into buckets of neighbouring ids, so the text moves once; only the ids of bucket heads are
    looked at across buckets, group by group, and only one row of each group across groups."""
    base = _bucketed(docs, id_col, tie)
    key = ["_g", "_b"]
    own = derive(base)
    order = [F.col(id_col).desc_nulls_last(), F.col(tie).desc_nulls_last()]
    own = own.withColumn("_n", F.lead(F.struct(*carry)).over(W.partitionBy(*key).orderBy(*order)))

    heads = base.groupBy(*key).agg(F.max(F.struct(F.col(id_col).alias("i"), F.col(tie).alias("t"))).alias("head"))
    heads = materialise(heads, "heads")
    inner = heads.withColumn("to", F.lead("head").over(W.partitionBy("_g").orderBy(F.desc("_b"))))
    groups = heads.groupBy("_g").agg(F.max_by("head", "_b").alias("ghead"))
    by_group = W.orderBy(F.desc("_g"))  # a row for each group
    top = by_group.rowsBetween(W.unboundedPreceding, W.currentRow)
    groups = groups.select("_g", F.coalesce(F.lead("ghead").over(by_group), F.first("ghead").over(top)).alias("gto"))
    to = inner.join(groups, "_g").select(*key, F.coalesce("to", "gto").alias("to")).select(*key, F.col("to.i").alias("i"), F.col("to.t").alias("t"))
    want = to.select("i", "t").distinct()
    want = F.broadcast(want) if heads.count() <= HEADS else want
    found = docs.join(want, docs[id_col].eqNullSafe(want["i"]) & docs[tie].eqNullSafe(want["t"]))
    found = derive(found).groupBy("i", "t").agg(*(F.first(c).alias(c) for c in carry))
    found = to.join(found, to["i"].eqNullSafe(found["i"]) & to["t"].eqNullSafe(found["t"])).select(*key, F.struct(*(found[c] for c in carry)).alias("_far"))
    out = own.join(found, key, "left").withColumn("_n", F.coalesce("_n", "_far"))
    return out.select(*[c for c in own.columns if c not in ("_g", "_b", "_n")], *(F.col("_n")[c].alias(f"next_{c}") for c in carry))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row for each document, with its own fingerprint and that of an edited text.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint (position:hash, positions in words),
    near_edited and near_next (Jaccard of hashes). The edited text is the document with its last third, in code
    points, replaced by as much of the beginning of the next document. A null text counts as empty; two empty
    fingerprints are alike (1). Repeated rows are next to each other (of one id, by the hash of the text). Of one
    row alone, it is its own next. An empty table gives an empty result. Other columns are ignored."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    both = with_next(base, ["text", "prints"], lambda df: winnow(df, "text", "prints", gram, window))
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("left(next_text, cast(floor(length(text) / 3) as int))")))
    both = winnow(both.select("id", "n_chars", "edited", "prints", "next_prints"), "edited", "eprints", gram, window)
    both = both.withColumn("_a", _hashes(F.col("prints"))).withColumn("_b", _hashes(F.col("eprints"))).withColumn("_c", _hashes(F.col("next_prints")))
    return both.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("prints")).alias("fingerprint"), as_text(F.col("eprints")).alias("edited_fingerprint"),
        likeness("_a", "_b").alias("near_edited"), likeness("_a", "_c").alias("near_next"),
    )
