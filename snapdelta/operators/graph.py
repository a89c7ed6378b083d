"""Bounded graph traversals, as unrolled joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.written import written


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within ``hops`` steps of the seeds (column node), in either direction, at their least
    distance. ``hops`` is at most 3."""
    if not 0 <= hops <= 3:
        raise ValueError("hops must be 0 to 3")
    both = written(undirected(edges), "undirected") if hops > 1 else undirected(edges)
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        step = seen.where(F.col("hop") == h - 1).join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        seen = seen.union(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(h)))
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among ``nodes`` (column node)."""
    n = nodes.select("node").distinct()
    return edges.join(n, edges["src"] == n["node"], "left_semi").join(n, F.col("dst") == n["node"], "left_semi")


def propagation(edges: DataFrame, seeds: DataFrame, extra: int = 20, hops: int = 2) -> DataFrame:
    """For each flow: distinct edges of which both ends are within reach and not both are seeds.

    ``seeds`` is (flow, node). Reach grows by calls in either direction, and is kept to the seeds and the first
    ``extra`` others by (hop, node). So a hop keeps only as many nodes as its flow has room for (a top-k that starts
    before the shuffle), and flows without room take no further step: the next one begins from fewer than ``extra``
    nodes a flow, whatever a hub brought."""
    both = written(undirected(edges), "undirected")
    seeds = seeds.select("flow", "node").distinct()
    seen = seeds.withColumn("hop", F.lit(0))
    front, room = seeds.withColumn("room", F.lit(extra)), None
    for h in range(1, hops + 1):
        near = front.join(both, F.col("node") == F.col("src")).select("flow", F.col("dst").alias("node"), "room").distinct().join(seen.select("flow", "node"), ["flow", "node"], "left_anti")
        ranked = near.withColumn("r", F.row_number().over(W.partitionBy("flow").orderBy("node"))).where(F.col("r") <= extra)
        kept = written(ranked.where(F.col("r") <= F.col("room")).select("flow", "node", "room"), "reach")
        seen = seen.union(kept.select("flow", "node", F.lit(h)))
        room = kept.groupBy("flow").agg((F.max("room") - F.count("*")).alias("room")).where("room > 0")
        front = kept.select("flow", "node").join(room, "flow")
    reach = seen.select("flow", "node", (F.col("hop") == 0).alias("seed"))
    a = reach.select("flow", F.col("node").alias("src"), F.col("seed").alias("src_seed"))
    b = reach.select("flow", F.col("node").alias("dst"), F.col("seed").alias("dst_seed"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, ["flow", "dst"]).where("not (src_seed and dst_seed)").select("flow", "src", "dst", "src_seed", "dst_seed")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of the component that each node of an edge lies in.

    Alternating stars: every node is tied to the smallest of its neighbours, first the larger neighbours, then the
    smaller ones; a round is two joins and is written. It is done when all that is left are stars. Null ends and
    loops do not count."""
    u, v = F.col(src), F.col(dst)
    e = written(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "components")
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "components")
        # stars: each node has one edge, and no centre has one
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
    raise RuntimeError("components did not settle")


def split_in_out(reached: DataFrame) -> DataFrame:
    """Which way a propagation edge runs, as seen from the flow's own entities."""
    way = F.when(F.col("src_seed"), "out").when(F.col("dst_seed"), "in").otherwise("through")
    return reached.withColumn("way", way)


def chain_connected(flow_edges: DataFrame) -> DataFrame:
    """For each flow: the number of edges, and whether each has an end that another edge of the flow touches."""
    e = flow_edges.select("flow", "src", "dst")
    ends = e.select("flow", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    degree = ends.groupBy("flow", "node").agg(F.count("*").alias("degree"))
    s, t = degree.select("flow", F.col("node").alias("src"), F.col("degree").alias("ds")), degree.select("flow", F.col("node").alias("dst"), F.col("degree").alias("dt"))
    return e.join(s, ["flow", "src"]).join(t, ["flow", "dst"]).groupBy("flow").agg(F.count("*").alias("edges"), F.bool_and(F.greatest("ds", "dt") >= 2).alias("connected"))


def levels(edges: DataFrame, nodes: DataFrame, group: str | None = None) -> DataFrame:
    """(node, level): the longest way to a node from one without callers, along ``edges`` (src, dst); with ``group``
    a column of both, in each group by itself.

    Rounds take away the nodes all of whose callers are done, each at one more than the highest of them. Where a
    group has none such, its nodes left are on cycles or behind them: the smallest is taken as done, which cuts its
    cycle. Loops and edges from outside ``nodes`` do not count. A round writes what is left, so that plans stay
    short; there are as many rounds as levels, and one more for each cut of a group."""
    g = group or "_all"
    node = (nodes if group else nodes.withColumn(g, F.lit(0))).select(g, "node").distinct()
    keep = (edges if group else edges.withColumn(g, F.lit(0))).where("src <> dst").select(g, "src", "dst").distinct()
    keep = keep.join(node.withColumnRenamed("node", "src"), [g, "src"], "left_semi").join(node.withColumnRenamed("node", "dst"), [g, "dst"], "left_semi")
    to_do, left = written(keep, "edges"), written(node.withColumn("level", F.lit(0)), "left")
    out, parts = left.limit(0), 0
    while left.limit(1).count():
        free = left.join(to_do.select(g, F.col("dst").alias("node")).distinct(), [g, "node"], "left_anti")
        stuck = left.join(free.select(g).distinct(), g, "left_anti").groupBy(g).agg(F.min("node").alias("node"))
        done = written(free.union(left.join(stuck, [g, "node"], "left_semi").select(free.columns)), "done")
        out, parts = out.union(done), parts + 1
        if parts >= 32:  # few tables to read in the plan, however many rounds
            out, parts = written(out, "levels"), 0
        src, dst = (done.select(g, F.col("node").alias(c)) for c in ("src", "dst"))
        above = to_do.join(done.select(g, F.col("node").alias("src"), "level"), [g, "src"]).groupBy(g, F.col("dst").alias("node")).agg((F.max("level") + 1).alias("least"))
        left = left.join(done.select(g, "node"), [g, "node"], "left_anti").join(above, [g, "node"], "left")
        left = written(left.select(g, "node", F.greatest("level", F.coalesce("least", "level")).alias("level")), "left")
        to_do = written(to_do.join(src, [g, "src"], "left_anti").join(dst, [g, "dst"], "left_anti"), "edges")
    return out if group else out.drop(g)


def edges_from(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that leave one of ``nodes`` (column node)."""
    return edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi")


def by_id(rows: DataFrame, ids: DataFrame, key: str = "node_id") -> DataFrame:
    """The rows of the given ids; an id that is not there gives a row of nulls."""
    return ids.select(key).distinct().join(rows, key, "left")
