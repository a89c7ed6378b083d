"""Operator 1: quotation linking, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

_MARKS = r"^(?:[ \t]*>)+"


def _normal(x: Column) -> Column:
    """Letters and digits in lower case, runs of anything else as one space."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def quotation_links(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", text: str = "text", least: int = 8) -> DataFrame:
    """One row for each message: its text without quotes, what it quotes, and its place in reply order.

    A line's quote level is its number of leading ``>`` marks. Neighbouring lines of one level form a
    passage. A passage is looked up by the hash of its normalised text among the unquoted passages of all
    messages, first as a whole, then line by line; passages and lines of fewer than ``least`` normalised
    characters name no message. The original is the first message with that passage in an earlier turn of
    the same conversation, or else one in the first other conversation (by its id) that has the passage. The parent is the original in the
    same conversation with most quoted characters at the lowest level quoted (ties: the later turn).

    Columns: the ids, ``body`` (no quotes), ``max_level``, ``n_quoted`` passages, ``n_linked`` passages found,
    ``parent_turn``, ``other_conv`` (a conversation quoted from outside), ``thread_turn`` (the first message of
    the thread) and ``depth``. Ordering by (conv, thread_turn, depth, turn) puts each message after the one it
    answers; without quotes that is the order of turns. A null text has null body and no quotes; rows of null
    conv or turn are kept and never linked; repeated rows are linked alike. An empty table gives an empty result.
    Other columns are ignored."""
    m = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text"))
    quoting = F.coalesce(F.col("text").rlike("(?m)" + _MARKS), F.lit(False))
    lines = F.split("text", "\n")
    level = F.transform(lines, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, "(" + _MARKS + ")", 1), "[^>]", "")))
    bodies = F.transform(lines, lambda x: F.regexp_replace(x, _MARKS + " ?", ""))
    plain = F.array(F.struct(F.lit(0).alias("level"), F.col("text").alias("body")))
    cut = m.withColumn("_q", quoting).withColumn("_l", F.when(F.col("_q"), level)).withColumn("_b", F.when(F.col("_q"), bodies))
    cut = cut.withColumn("_s", F.expr("filter(sequence(0, size(_l) - 1), i -> i = 0 or _l[i] <> _l[greatest(i - 1, 0)])"))
    runs = F.expr("transform(_s, (s, j) -> struct(_l[s] as level, array_join(slice(_b, s + 1, coalesce(try_element_at(_s, j + 2), size(_l)) - s), '\n') as body))")
    cut = cut.withColumn("runs", F.when(F.col("_q"), runs).when(F.col("text").isNotNull(), plain))
    cut = cut.select(
        "conv", "turn", "runs",
        F.when(F.col("_q"), F.expr("array_join(transform(filter(runs, r -> r.level = 0), r -> r.body), '\n')")).otherwise(F.col("text")).alias("body"),
        F.coalesce(F.when(F.col("_q"), F.array_max("_l")), F.lit(0)).alias("max_level"),
    )
    # only messages that some quote could name matter; without a quote nothing below has rows
    run = cut.where("conv is not null and turn is not null").select("conv", "turn", F.posexplode_outer("runs").alias("no", "run")).select("conv", "turn", "no", "run.level", F.col("run.body").alias("body"))
    whole = run.select("conv", "turn", "no", "level", F.lit(-1).alias("line"), F.col("body").alias("piece"))
    by_line = run.where("instr(body, '\n') > 0").select("conv", "turn", "no", "level", F.posexplode(F.split("body", "\n")).alias("line", "piece"))
    pieces = whole.union(by_line).withColumn("norm", _normal(F.col("piece"))).where(F.length("norm") >= least)
    pieces = pieces.select("conv", "turn", "no", "level", "line", F.sha2("norm", 256).alias("hash"), F.length("norm").alias("size"))
    pieces = materialise(pieces, "passages")
    said = pieces.where("level = 0")
    quoted = pieces.where("level > 0")
    here = said.groupBy("hash", "conv").agg(F.min("turn").alias("here_turn"))
    asked = quoted.select("hash").distinct()
    said_in = here.join(asked, "hash", "left_semi").select("hash", "conv")
    first = said_in.groupBy("hash").agg(F.min("conv").alias("first"))
    second = said_in.join(first, "hash").where("conv > first").groupBy("hash").agg(F.min("conv").alias("second"))
    hit = quoted.join(here, ["hash", "conv"], "left").join(first, "hash", "left").join(second, "hash", "left")
    hit = hit.withColumn("same", F.coalesce(F.col("here_turn") < F.col("turn"), F.lit(False)))
    elsewhere = F.when(F.col("first") != F.col("conv"), F.col("first")).otherwise(F.col("second"))
    hit = hit.withColumn("o_turn", F.when(F.col("same"), F.col("here_turn"))).withColumn("o_conv", F.when(F.col("same"), F.col("conv")).otherwise(elsewhere))
    found = hit.groupBy("conv", "turn", "no").agg(F.max(F.col("o_conv").isNotNull() & (F.col("line") == -1)).alias("as_whole"))
    hit = hit.join(found, ["conv", "turn", "no"]).where("line = -1 or not as_whole")
    passages = hit.groupBy("conv", "turn", "no").agg(F.max(F.col("o_conv").isNotNull()).alias("linked"))
    counts = passages.groupBy("conv", "turn").agg(F.sum(F.col("linked").cast("int")).alias("n_linked"))
    asked = hit.where("o_conv is not null and same").groupBy("conv", "turn", "level", "o_turn").agg(F.sum("size").alias("size"))
    parent = asked.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), "size", "o_turn")).alias("best")).select("conv", "turn", F.col("best.o_turn").alias("parent_turn"))
    outside = hit.where("o_conv is not null and not same").groupBy("conv", "turn").agg(F.min("o_conv").alias("other_conv"))
    parent = materialise(parent, "parents")

    up = parent.select("conv", "turn", F.col("parent_turn").alias("top"), F.lit(1).alias("depth"))
    while True:  # each round doubles the steps climbed; parents are earlier turns, so it ends
        above = up.select("conv", F.col("turn").alias("top"), F.col("top").alias("top2"), F.col("depth").alias("depth2"))
        joined = up.join(above, ["conv", "top"], "left")
        if joined.where("top2 is not null").limit(1).count() == 0:
            break
        up = materialise(joined.select("conv", "turn", F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")), "threads")
    keys = ["conv", "turn"]
    linked = parent.join(up, keys).join(counts, keys, "full").join(outside, keys, "full")
    out = cut.join(linked, keys, "left")
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), "body", "max_level", F.coalesce(F.expr("size(filter(runs, r -> r.level > 0))"), F.lit(0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn", "other_conv", F.coalesce("top", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def in_reply_order(linked: DataFrame, *, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The messages of each conversation in reply order (a range sort: a large conversation spans tasks)."""
    return linked.orderBy(conv, "thread_turn", "depth", turn)
