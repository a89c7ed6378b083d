"""Navigation cost: probe aggregates, attribution to flows, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The weights of a visit, a token and a session.
VISIT, TOKEN, SESSION = 1.0, 0.001, 2.0


def probe_entities(visits: DataFrame, tokens: DataFrame) -> DataFrame:
    """(side, probe, entity, visits) and (side, probe, tokens_out) to the tokens and cost of each entity: tokens
    are dealt by visits, half a token rounds up."""
    total = visits.groupBy("side", "probe").agg(F.sum("visits").alias("all_visits")).join(tokens, ["side", "probe"])
    out = visits.join(total, ["side", "probe"])
    each = F.round(F.col("visits") * F.col("tokens_out") / F.col("all_visits")).cast("long")
    out = out.withColumn("tokens", F.when(F.col("all_visits") > 0, each).otherwise(F.lit(0).cast("long")))
    return out.select("side", "probe", "entity", "visits", "tokens", F.round(VISIT * F.col("visits") + TOKEN * F.col("tokens") + SESSION, 6).alias("cost"))


def entity_totals(entities: DataFrame) -> DataFrame:
    """Sums over the probes of a side: visits, tokens, the sessions an entity was seen in, and its cost."""
    by = entities.groupBy("side", "entity").agg(F.sum("visits").alias("visits"), F.sum("tokens").alias("tokens"), F.count("*").alias("sessions"))
    return by.withColumn("cost", F.round(VISIT * F.col("visits") + TOKEN * F.col("tokens") + SESSION * F.col("sessions"), 6))


def probe_totals(entities: DataFrame) -> DataFrame:
    return entities.groupBy("side", "probe").agg(F.sum("visits").alias("visits"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost")).cast("long").alias("cost"))


def clamped(base: Column, head: Column) -> Column:
    """The change that counts: growth of what was there, all of what is new, less what is gone. What shrank but
    stays counts nothing."""
    return F.when(base.isNotNull() & head.isNotNull(), F.greatest(head - base, F.lit(0.0))).when(base.isNull(), head).otherwise(-base)


def attribute(flow_entities: DataFrame, entities: DataFrame, value: str = "cost") -> DataFrame:
    """(flow, entity) against probe_entities: the clamped change of each (flow, probe, entity)."""
    b = entities.where("side = 'base'").select("probe", "entity", F.col(value).cast("double").alias("before"))
    h = entities.where("side = 'head'").select("probe", "entity", F.col(value).cast("double").alias("after"))
    change = b.join(h, ["probe", "entity"], "full").select("probe", "entity", clamped(F.col("before"), F.col("after")).alias("change"))
    return flow_entities.select("flow", "entity").distinct().join(change, "entity")


def axes(attributed: DataFrame) -> DataFrame:
    """The rounded change of each (flow, probe), and the entity that moved most (ties: the larger name)."""
    mover = F.max(F.struct(F.abs("change"), F.col("entity"))).getField("entity")
    return attributed.groupBy("flow", "probe").agg(F.round(F.round(F.sum("change"), 6)).cast("long").alias("axis"), mover.alias("mover"))


def flow_cost(axes_: DataFrame) -> DataFrame:
    """The net of each flow, its axes side by side."""
    probes = ("click", "purchase", "view")
    each = [F.coalesce(F.sum(F.when(F.col("probe") == p, F.col("axis"))), F.lit(0)).alias(p) for p in probes]
    return axes_.groupBy("flow").agg(*each, F.sum("axis").alias("net"))


def drivers(axes_: DataFrame) -> DataFrame:
    """The axes that moved; they sum to the net."""
    return axes_.where("axis <> 0")


def confidence(axes_: DataFrame, flows: DataFrame) -> DataFrame:
    """How far a flow's cost can be trusted: no driver .3, one .55, several of one sign .85, mixed .55."""
    d = drivers(axes_).groupBy("flow").agg(F.count("*").alias("n"), F.min(F.signum("axis")).alias("lo"), F.max(F.signum("axis")).alias("hi"))
    n = F.coalesce("n", F.lit(0))
    c = F.when(n == 0, 0.3).when(n == 1, 0.55).when(F.col("lo") == F.col("hi"), 0.85).otherwise(0.55)
    return flows.select("flow").distinct().join(d, "flow", "left").select("flow", n.alias("drivers"), c.alias("confidence"), (c >= 0.70).alias("trusted"))


def pr_totals(costs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Net of all flows, and its percentage of the base axes (null if those are not above 0)."""
    net = costs.agg(F.coalesce(F.sum("net"), F.lit(0)).alias("net"))
    base = baseline.where("side = 'base'").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("base"))
    return net.crossJoin(base).select("net", "base", F.when(F.col("base") > 0, F.round(F.col("net") * 100.0 / F.col("base"), 6)).alias("net_pct"))  # one row each


def share_of_baseline(costs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each flow's net as a percentage of the base axes, at most 100."""
    base = baseline.where("side = 'base'").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("base"))
    pct = F.when(F.col("base") > 0, F.least(F.lit(100.0), F.abs("net") * 100.0 / F.col("base"))).otherwise(0.0)
    return costs.crossJoin(F.broadcast(base)).select("flow", F.round(pct, 6).alias("pct"))  # one row


def contributions(costs: DataFrame) -> DataFrame:
    """Flows by the size of their net."""
    return costs.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.abs("net")), "flow"))).select("rank", "flow", "net")


def baseline_summary(totals: DataFrame, flows: DataFrame, axes: dict[str, str]) -> DataFrame:
    """One row of an analysis' baseline: tokens of both sides, the base cost of the probe that each of ``axes`` names, and,
    by the order of flows (position, source_model, proof_model), the first model that proposed a flow and the first
    that gave a proof; null where none did."""
    of = lambda c, cond: F.sum(F.when(cond, F.col(c)))
    on = lambda s: F.col("side") == s
    sums = totals.agg(of("tokens", on("base")).alias("tokens_base"), of("tokens", on("head")).alias("tokens_head"), *(of("cost", on("base") & (F.col("probe") == p)).alias(axis) for axis, p in axes.items()))
    first = lambda c, name: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(name)
    models = flows.agg(first("source_model", "synthesis_model"), first("proof_model", "proof_model"))
    return sums.crossJoin(models)  # one row each
