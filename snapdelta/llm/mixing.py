"""Operator 9: mixing to target weights by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise

#: Up to so many cells are broadcast.
MOST_SENT = 200_000
#: Pairs of a language and a topic that the driver may hold; sources may be many.
MOST_PAIRS = 100_000


def token_count(text: Column) -> Column:
    """Tokens of a text: runs of other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse content class from fixed cues (the first that holds)."""
    low = F.lower(text)
    says = lambda *cues: F.lit(False) if not cues else F.contains(low, F.lit(cues[0])) | says(*cues[1:])
    return (
        F.when(~F.coalesce(text.rlike(r"\S"), F.lit(False)), "none")
        .when(says("licensed", "all rights reserved", "copyright"), "legal")
        .when(F.contains(text, F.lit("@")) & text.rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]"), "contact")
        .when(F.length(text) < 1000, "short")
        .when(F.length(text) < 5000, "article")
        .otherwise("long")
    )


def shares(tokens: dict, alpha: float) -> dict:
    """Target shares: shares of tokens to the power ``alpha``, made to sum to 1. At 1 the mix stays, at 0 all
    values weigh alike; values without tokens weigh nothing."""
    powered = {k: float(v) ** alpha if v else 0.0 for k, v in tokens.items()}
    whole = sum(powered.values())
    return {k: v / whole if whole else 0.0 for k, v in powered.items()}


def _factor(of: dict, key: Column) -> Column:
    """The factor of a value, null being a value too."""
    named = {k: v for k, v in of.items() if k is not None}
    known = F.create_map(*(F.lit(x) for kv in named.items() for x in kv)) if named else None
    got = F.lit(0.0) if known is None else F.coalesce(F.try_element_at(known, key), F.lit(0.0))
    return F.when(key.isNull(), F.lit(float(of.get(None, 0.0)))).otherwise(got)


def reachable(goal: dict, tokens: dict) -> dict:
    """Given shares over the values that have tokens, made to sum to 1; a value without a goal gets none."""
    kept = {k: max(float(goal.get(k, 0.0)), 0.0) if v else 0.0 for k, v in tokens.items()}
    whole = sum(kept.values())
    if not whole and any(tokens.values()):
        raise ValueError("no value with tokens has a target")
    return {k: v / whole if whole else 0.0 for k, v in kept.items()}


def rake(cells: DataFrame, alpha: float, *, targets: dict | None = None, rounds: int = 200, tolerance: float = 1e-7) -> tuple[DataFrame, float]:
    """``cells`` (_s, _l, _t, tokens) with ``weight``: tokens scaled until the sums by each dimension meet their
    targets (iterative proportional fitting); and the largest difference that is left.

    ``targets`` may give tables (value, share) or dicts for ``source``, ``lang`` and ``topic``; what it does not give is
    worked out by ``shares``. Sources may be many: a source's cells are one row, and its factor is worked out in that
    row, so that the source step moves no data. Languages and topics are few by nature (more than MOST_PAIRS pairs are an
    error): each round sums the weights by language and topic, one small aggregation, from which both their factors
    follow."""
    spark, targets = cells.sparkSession, targets or {}
    packed = cells.groupBy("_s").agg(F.collect_list(F.struct("_l", "_t", "tokens")).alias("own"), F.sum("tokens").cast("double").alias("all"))
    aim = targets.get("source")
    if aim is None:
        packed = packed.withColumn("aim", F.when(F.col("all") > 0, F.pow("all", F.lit(float(alpha)))).otherwise(0.0))
    else:
        if isinstance(aim, dict):
            aim = spark.createDataFrame([(k, float(v)) for k, v in aim.items()], "value string, share double")
        aim = aim.groupBy(F.col("value").alias("_v")).agg(F.sum("share").alias("_share"))
        packed = packed.join(aim, F.col("_s").eqNullSafe(F.col("_v")), "left").drop("_v")
        packed = packed.withColumn("aim", F.when(F.col("all") > 0, F.greatest(F.coalesce("_share", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)).drop("_share")
    packed = materialise(packed, "cells")
    tokens, whole = packed.agg(F.sum("all"), F.sum("aim")).first()
    if tokens and aim is not None and not whole:
        raise ValueError("no source with tokens has a target")

    def goals(name: str, column: str) -> dict:
        tokens = {r[0]: r[1] for r in cells.groupBy(column).agg(F.sum("tokens")).collect()}
        given = targets.get(name)
        if given is None:
            return shares(tokens, alpha)
        return reachable(given if isinstance(given, dict) else {r["value"]: r["share"] for r in given.collect()}, tokens)

    goal_l, goal_t = goals("lang", "_l"), goals("topic", "_t")
    if len(goal_l) * len(goal_t) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of a language and a topic")
    f_l, f_t, gap = dict.fromkeys(goal_l, 1.0), dict.fromkeys(goal_t, 1.0), 0.0

    def weighed() -> DataFrame:
        scaled = packed.withColumn("own", F.transform("own", lambda c: c.withField("w", c["tokens"] * _factor(f_l, c["_l"]) * _factor(f_t, c["_t"]))))
        scaled = scaled.withColumn("z", F.aggregate("own", F.lit(0.0), lambda a, c: a + c["w"]))
        each = scaled.select("_s", (F.col("aim") / F.lit(float(whole or 1.0))).alias("goal"), "z", F.explode("own").alias("c"))
        weight = F.when(F.col("z") > 0, F.col("c.w") * F.col("goal") / F.col("z")).otherwise(0.0)
        return each.select("_s", "c._l", "c._t", "c.tokens", weight.alias("weight"))

    for _ in range(rounds):
        m = {(r["_l"], r["_t"]): r["w"] for r in weighed().groupBy("_l", "_t").agg(F.sum("weight").alias("w")).collect()}
        sum_l, sum_t, after = dict.fromkeys(goal_l, 0.0), dict.fromkeys(goal_t, 0.0), dict.fromkeys(goal_t, 0.0)
        for (a, b), w in m.items():
            sum_l[a] += w
            sum_t[b] += w
        gap = max([0.0, *(abs(sum_l[x] - goal_l[x]) for x in goal_l), *(abs(sum_t[x] - goal_t[x]) for x in goal_t)])
        if gap < tolerance:
            break
        step = {x: goal_l[x] / sum_l[x] if sum_l[x] > 0 else 0.0 for x in goal_l}
        for (a, b), w in m.items():
            after[b] += w * step[a]
        f_l = {x: f_l[x] * step[x] for x in f_l}
        f_t = {x: f_t[x] * (goal_t[x] / after[x] if after[x] > 0 else 0.0) for x in f_t}
    return weighed(), gap


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source: str = "source", lang: str = "lang", targets: dict | None = None, topic_col: str | None = None, tokens_col: str | None = None,
    alpha: float = 0.7, share: float = 0.8, seed: int = 9, rounds: int = 200, most_gap: float | None = 0.01,
) -> DataFrame:
    """All columns of ``docs`` and ``_topic``, ``_tokens``, ``_weight``, ``_p``, ``_take``, ``_gap`` for each row (in place
    of columns of these names that ``docs`` has).

    Token weights by source, language and topic are raked to the targets: ``targets`` gives tables (value, share) or
    dicts for any of ``source``, ``lang`` and ``topic``; the others weigh by their share of tokens to the power ``alpha``.
    Topics and tokens are taken from ``topic_col`` and ``tokens_col`` if these are given (clusters, or counts of a
    tokenizer), else from ``topic`` and ``token_count``. ``_gap`` is the largest difference of a marginal from its
    target; where it is more than ``most_gap``, that is an error if targets are given, else a warning (None: neither).

    A row is taken with chance ``_p`` = min(1, c * weight / tokens) of its cell; c is such that the tokens expected are
    ``share`` of all (a cell that would need more than it has gives all). The draw is the hash of the id, or of the
    text where the id is null, so it can be repeated; ``_weight`` / _p corrects what the bound of 1 leaves. Null sources
    and languages are values of their own. Null and blank texts have no tokens and are not taken. Repeated rows are
    drawn alike. An empty table gives an empty result. Cells are sent to all tasks up to MOST_SENT of them (a few
    tens of MB); beyond that they are joined."""
    t = F.col(text_col)
    docs = docs.drop(*(c for c in ("_topic", "_tokens", "_weight", "_p", "_take", "_gap") if c not in (topic_col, tokens_col)))
    about = F.col(topic_col).cast("string") if topic_col else topic(t)
    size = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)) if tokens_col else token_count(t)
    narrow = docs.select(F.col(source).alias("_s"), F.col(lang).alias("_l"), about.alias("_t"), size.alias("_n"))
    cells = materialise(narrow.groupBy("_s", "_l", "_t").agg(F.sum("_n").alias("tokens")), "cells")
    raked, gap = rake(cells, alpha, targets=targets, rounds=rounds)
    if most_gap is not None and gap > most_gap:
        if targets:
            raise ValueError(f"the targets cannot be met: a marginal is off by {gap:.4f}")
        warnings.warn(f"the mix did not settle: a marginal is off by {gap:.4f}", stacklevel=2)
    raked = materialise(raked, "raked")
    raked = raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    c, settled = share * whole, False
    for _ in range(200):  # cells at their bound pass what is missing on to the others
        full, rest = raked.agg(F.sum(F.when(F.col("ratio") * c >= 1, F.col("tokens"))), F.sum(F.when(F.col("ratio") * c < 1, F.col("weight")))).first()
        fit = (share * whole - (full or 0)) / rest if rest else c
        if fit <= c * (1 + 1e-9):
            settled = True
            break
        c = fit
    if not settled:
        raise RuntimeError("the chances did not settle")
    s, l_, t_ = (free_name(x, docs.columns) for x in ("_s", "_l", "_t"))
    chance = F.when(F.col("ratio").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("ratio") * F.lit(float(c))))
    sent = raked.select(F.col("_s").alias(s), F.col("_l").alias(l_), F.col("_t").alias(t_), F.col("weight").alias("_weight"), chance.alias("_p"))
    sent = F.broadcast(sent) if cells.count() <= MOST_SENT else sent
    own = docs.withColumn("_topic", about).withColumn("_tokens", size)
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    draw = F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), t)).otherwise(key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    joined = own.join(sent, own[source].eqNullSafe(sent[s]) & own[lang].eqNullSafe(sent[l_]) & own["_topic"].eqNullSafe(sent[t_]), "left")
    return joined.select(*(own[c] for c in own.columns), "_weight", "_p", (draw < F.col("_p")).alias("_take"), F.lit(gap).alias("_gap"))
