"""Clusters of related deltas ("flows"): building, checking, ranking, changing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.written import written
from .graph import components

# Names that a flow may not have, and the least and most bytes of a name and of a rationale.
RESERVED = ("misc", "various", "other", "unknown", "cluster", "group")
NAME_BYTES, RATIONALE_BYTES = (3, 48), (1, 240)
TOP_LEVEL = "top-level"


def membership(hunk_entities: DataFrame) -> DataFrame:
    """(hunk_id, entity) to (flow, hunk_id): a hunk's flow is the part before the first dot of its first entity, by
    name, that has one; else top-level. A plain minimum, so that a hunk of any number of entities is one small state."""
    dotted = F.min(F.when(F.contains("entity", F.lit(".")), F.col("entity")))
    by_hunk = hunk_entities.groupBy("hunk_id").agg(dotted.alias("first"))
    return by_hunk.select(F.coalesce(F.split_part("first", F.lit("."), F.lit(1)), F.lit(TOP_LEVEL)).alias("flow"), "hunk_id")


def structural(hunk_entities: DataFrame) -> DataFrame:
    """(hunk_id, entity) to flows (flow, n_hunks, hunks, entities, position), hunks grouped by their bucket.

    Flows are numbered by name order: only their names are sorted in one task, and joined back."""
    member = membership(hunk_entities)
    hunks = member.groupBy("flow").agg(F.count("*").alias("n_hunks"), F.array_sort(F.collect_list("hunk_id")).alias("hunks"))
    pairs = hunk_entities.select("hunk_id", "entity").join(member, "hunk_id").select("flow", "entity").distinct()
    entities = pairs.groupBy("flow").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    names = member.select("flow").distinct()
    place = names.withColumn("position", F.row_number().over(W.orderBy("flow")) - 1)  # a row for each flow, its name alone
    return hunks.join(entities, "flow").join(place, "flow")


def weight(n_hunks: Column, n_entities: Column) -> Column:
    return 2 * n_hunks + n_entities


def uncovered(hunks: DataFrame, flow_hunks: DataFrame) -> DataFrame:
    """Hunks in no flow."""
    return hunks.select("hunk_id").distinct().join(flow_hunks, "hunk_id", "left_anti")


def orphaned_by_removal(flow_hunks: DataFrame) -> DataFrame:
    """For each flow the number of hunks that would be in no flow if it were removed."""
    own = flow_hunks.select("flow", "hunk_id").distinct()
    alone = own.groupBy("hunk_id").agg(F.count("*").alias("n"), F.min("flow").alias("flow")).where("n = 1")
    lost = alone.groupBy("flow").agg(F.count("*").alias("orphans"))
    return own.select("flow").distinct().join(lost, "flow", "left").select("flow", F.coalesce("orphans", F.lit(0)).alias("orphans"))


def name_error(name: Column) -> Column:
    """The error code of a flow name, or null."""
    size = F.octet_length(name)
    return F.when(size < NAME_BYTES[0], "NAME_TOO_SHORT").when(size > NAME_BYTES[1], "NAME_TOO_LONG").when(F.lower(name).isin(*RESERVED), "NAME_RESERVED")


def rationale_error(text: Column) -> Column:
    size = F.octet_length(text)
    return F.when(size < RATIONALE_BYTES[0], "RATIONALE_TOO_SHORT").when(size > RATIONALE_BYTES[1], "RATIONALE_TOO_LONG")


def proposal_errors(proposals: DataFrame, hunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(flow, name, rationale, hunk_ids, extra_entities) with ``error``: the first of name, rationale, hunks and
    entities that does not pass (null: accepted). hunks has hunk_id, entities has entity."""
    missing = lambda c, known, key: proposals.select("flow", F.explode(c).alias(key)).join(known.select(key).distinct(), key, "left_anti").select("flow").distinct()
    no_hunk = missing("hunk_ids", hunks, "hunk_id").withColumn("_h", F.lit("HUNK_NOT_FOUND"))
    no_entity = missing("extra_entities", entities, "entity").withColumn("_e", F.lit("ENTITY_NOT_FOUND"))
    both = proposals.join(no_hunk, "flow", "left").join(no_entity, "flow", "left")
    return both.withColumn("error", F.coalesce(name_error(F.col("name")), rationale_error(F.col("rationale")), "_h", "_e")).drop("_h", "_e")


def removal_errors(flow_hunks: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked flow: FLOW_NOT_FOUND, COVERAGE_BROKEN if a hunk would be in no flow, or null, and how many."""
    lost = orphaned_by_removal(flow_hunks)
    error = F.when(F.col("orphans").isNull(), "FLOW_NOT_FOUND").when(F.col("orphans") > 0, "COVERAGE_BROKEN")
    return asked.select("flow").distinct().join(lost, "flow", "left").select("flow", error.alias("error"), F.coalesce("orphans", F.lit(0)).alias("orphans"))


def finalize_violation(hunks: DataFrame, flow_hunks: DataFrame, flow_entities: DataFrame, names: DataFrame, known: DataFrame, calls: int, most_calls: int = 200) -> DataFrame:
    """Counts of violations by rule, in the order in which they are reported: coverage, names, unknown entities,
    unknown hunks, calls. The first rule with a violation decides; ``first`` marks it."""
    spark = hunks.sparkSession
    foreign = flow_hunks.select("flow", "hunk_id").distinct().join(hunks.select("hunk_id").distinct(), "hunk_id", "left_anti")
    rules = (
        uncovered(hunks, flow_hunks).agg(F.count("*").alias("n")).select(F.lit(1).alias("rank"), F.lit("coverage").alias("rule"), "n")
        .union(names.where(name_error(F.col("flow")) == "NAME_RESERVED").agg(F.count("*")).select(F.lit(2), F.lit("reserved-name"), "*"))
        .union(flow_entities.join(known.select("entity").distinct(), "entity", "left_anti").agg(F.count("*")).select(F.lit(3), F.lit("entity-not-found"), "*"))
        .union(foreign.agg(F.count("*")).select(F.lit(4), F.lit("hunk-not-found"), "*"))
        .union(spark.range(1).select(F.lit(5), F.lit("call-budget"), F.lit(max(calls - most_calls, 0)).cast("long")))
    )
    least = F.min(F.when(F.col("n") > 0, F.col("rank"))).over(W.partitionBy(F.lit(1)))  # five rows
    return rules.withColumn("first", F.coalesce(F.col("rank") == least, F.lit(False)))


def partition_errors(cluster_hunks: DataFrame, parts: DataFrame) -> DataFrame:
    """(flow, hunk_id) of a cluster against (flow, part, hunk_id) proposed: hunks that are foreign, doubled or
    missing, by flow; none means an exact partition."""
    c = cluster_hunks.select("flow", "hunk_id").distinct()
    p = parts.groupBy("flow", "hunk_id").agg(F.count("*").alias("times"))
    both = c.withColumn("_in", F.lit(1)).join(p, ["flow", "hunk_id"], "full")
    count = lambda cond: F.count(F.when(cond, 1))
    return both.groupBy("flow").agg(
        count(F.col("_in").isNull()).alias("foreign"), count(F.col("times") > 1).alias("doubled"), count(F.col("times").isNull()).alias("missing")
    )


def assemble(flows: DataFrame, proposals: DataFrame) -> DataFrame:
    """Structural flows (flow, hunk_id) with valid proposals (flow, new_name, part, hunk_id): a flow without a
    proposal keeps its name and hunks, a split gives one flow for each part."""
    split = proposals.select("flow", "new_name", "hunk_id")
    kept = flows.join(proposals.select("flow").distinct(), "flow", "left_anti").select("flow", F.col("flow").alias("new_name"), "hunk_id")
    return kept.union(split).withColumn("source", F.when(F.col("flow") == F.col("new_name"), "structural").otherwise("proposed"))


def edit(flow_hunks: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Apply (flow, hunk_id) additions, then removals: what is both added and removed is gone."""
    both = flow_hunks.select("flow", "hunk_id").union(add.select("flow", "hunk_id")).distinct()
    return both.join(remove.select("flow", "hunk_id").distinct(), ["flow", "hunk_id"], "left_anti")


#: What a patch of a flow may hold; a null leaves things as they are.
PATCH = "flow string, name string, rationale string, add_hunks array<string>, remove_hunks array<string>, add_entities array<string>, remove_entities array<string>"


def patch_errors(patches: DataFrame, flows: DataFrame, hunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Patches (see PATCH; one for each flow) with ``error``: the first of name, rationale, hunks, entities and the flow
    itself that does not pass. Every id is looked up before anything changes, those to be removed included; a flow
    that does not exist is told last. A patch with an error changes nothing."""

    def missing(added: str, removed: str, known: DataFrame, key: str, code: str) -> DataFrame:
        named = patches.select("flow", F.explode(F.array_union(F.coalesce(added, F.array().cast("array<string>")), F.coalesce(removed, F.array().cast("array<string>")))).alias(key))
        return named.join(known.select(key).distinct(), key, "left_anti").select("flow").distinct().withColumn(code, F.lit(code))

    checked = patches.join(missing("add_hunks", "remove_hunks", hunks, "hunk_id", "HUNK_NOT_FOUND"), "flow", "left")
    checked = checked.join(missing("add_entities", "remove_entities", entities, "entity", "ENTITY_NOT_FOUND"), "flow", "left")
    checked = checked.join(flows.select("flow", F.lit(True).alias("_is")).distinct(), "flow", "left")
    error = F.coalesce(name_error(F.col("name")), rationale_error(F.col("rationale")), "HUNK_NOT_FOUND", "ENTITY_NOT_FOUND", F.when(F.col("_is").isNull(), "FLOW_NOT_FOUND"))
    return checked.withColumn("error", error).select(*patches.columns, "error")


def mutated(flows: DataFrame, flow_hunks: DataFrame, flow_entities: DataFrame, patches: DataFrame, hunk_entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flow, name, rationale), (flow, hunk_id) and (flow, entity, extra) after patches without an error.

    Additions come before removals. Of a patched flow the entities are derived again from its hunks; those named by hand
    (``extra``) grow by what the flow did not have before, and lose what is removed. Other flows stay as they are."""
    own = patches.select("flow", F.col("name").alias("_n"), F.col("rationale").alias("_r"))
    named = flows.join(own, "flow", "left").select("flow", F.coalesce("_n", "name").alias("name"), F.coalesce("_r", "rationale").alias("rationale"))
    listed = lambda c, key: patches.select("flow", F.explode(c).alias(key)).distinct()
    hunks = edit(flow_hunks, listed("add_hunks", "hunk_id"), listed("remove_hunks", "hunk_id"))
    touched = patches.select("flow").distinct()
    new = listed("add_entities", "entity").join(flow_entities.select("flow", "entity"), ["flow", "entity"], "left_anti")
    by_hand = flow_entities.where("extra").select("flow", "entity").union(new).distinct().join(listed("remove_entities", "entity"), ["flow", "entity"], "left_anti")
    derived = hunks.join(touched, "flow", "left_semi").join(hunk_entities.select("hunk_id", "entity").distinct(), "hunk_id").select("flow", "entity").distinct()
    kept = flow_entities.where("not extra").select("flow", "entity").join(touched, "flow", "left_anti")
    return named, hunks, derived.union(kept).withColumn("extra", F.lit(False)).union(by_hand.withColumn("extra", F.lit(True)))


def jaccard_pairs(a: DataFrame, b: DataFrame, group: str = "flow", item: str = "hunk_id") -> DataFrame:
    """Pairs of groups that share an item: shared, a_only, b_only, jaccard."""
    a, b = a.select(F.col(group).alias("flow_a"), item).distinct(), b.select(F.col(group).alias("flow_b"), item).distinct()
    na, nb = a.groupBy("flow_a").agg(F.count("*").alias("na")), b.groupBy("flow_b").agg(F.count("*").alias("nb"))
    shared = a.join(b, item).groupBy("flow_a", "flow_b").agg(F.count("*").alias("shared")).join(na, "flow_a").join(nb, "flow_b")
    return shared.select("flow_a", "flow_b", "shared", (F.col("na") - F.col("shared")).alias("a_only"), (F.col("nb") - F.col("shared")).alias("b_only"), F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


#: Pairs of one component that are walked in one task; larger components shrink in rounds first.
WALKED = 1_000_000


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """One-to-one pairing: flows of A by falling number of hunks (ties: name) each take the most similar flow of B
    that is left (ties: name). ``pairs`` comes from ``jaccard_pairs``; flows that share nothing are never paired.

    Flows of different components of the pair graph never want the same, so each component is walked by itself, in one
    pass over its sorted pairs that remembers only who is taken. Components of more than ``WALKED`` pairs shrink in
    rounds before: every flow of A names its best B, and every B accepts the first A in the order among all that could
    still come to it; such pairs are what the walk takes."""
    left = pairs.select("flow_a", "flow_b", "jaccard", (F.col("shared") + F.col("a_only")).alias("size")).where("flow_a is not null and flow_b is not null")
    left = written(left, "left")
    part = components(left.select(F.concat(F.lit("a "), "flow_a").alias("src"), F.concat(F.lit("b "), "flow_b").alias("dst")))
    left = left.join(part.select(F.expr("substring(node, 3)").alias("flow_a"), "label", F.col("node").startswith("a ").alias("_a")).where("_a").drop("_a"), "flow_a")
    left = written(left, "left")
    huge = left.groupBy("label").count().where(F.col("count") > WALKED).select("label")
    out = _walked(left.join(huge, "label", "left_anti"))
    rest = left.join(huge, "label", "left_semi")
    while rest.limit(1).count():
        best = rest.groupBy("flow_a").agg(F.min(F.struct(-F.col("jaccard"), "flow_b")).alias("m")).select("flow_a", F.col("m.flow_b").alias("flow_b"))
        turn = rest.groupBy("flow_b").agg(F.min(F.struct(-F.col("size"), "flow_a")).alias("m")).select("flow_b", F.col("m.flow_a").alias("flow_a"))
        taken = written(rest.join(best, ["flow_a", "flow_b"], "left_semi").join(turn, ["flow_a", "flow_b"], "left_semi").select("flow_a", "flow_b", "jaccard"), "pairs")
        out = written(out.union(taken), "pairs")
        rest = written(rest.join(taken, "flow_a", "left_anti").join(taken.select("flow_b"), "flow_b", "left_anti"), "left")
        small = rest.groupBy("label").count().where(F.col("count") <= WALKED).select("label")
        out = out.union(_walked(rest.join(small, "label", "left_semi")))
        rest = written(rest.join(small, "label", "left_anti"), "left")
    return out


def _walked(left: DataFrame) -> DataFrame:
    """The plain walk over each component (label, flow_a, flow_b, jaccard, size)."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = served = None
        taken: set[str] = set()
        for rows in batches:
            out = []
            for of, a, b, jaccard in rows[["label", "flow_a", "flow_b", "jaccard"]].itertuples(index=False, name=None):
                if of != label:
                    label, served, taken = of, None, set()
                if a != served and b not in taken:
                    out.append((a, b, jaccard))
                    taken.add(b)
                    served = a
            yield pd.DataFrame(out, columns=["flow_a", "flow_b", "jaccard"])

    order = ["label", F.desc("size"), "flow_a", F.desc("jaccard"), "flow_b"]
    return left.repartition("label").sortWithinPartitions(*order).mapInPandas(walk, "flow_a string, flow_b string, jaccard double")


def agreement(pairs: DataFrame, a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """The share of distinct hunks that sit in flows of both sides with a similarity of ``least`` or more."""
    close = pairs.where(F.col("jaccard") >= least).select("flow_a", "flow_b")
    x, y = a.select(F.col("flow").alias("flow_a"), "hunk_id"), b.select(F.col("flow").alias("flow_b"), "hunk_id")
    agreed = x.join(close, "flow_a").join(y, ["flow_b", "hunk_id"]).select("hunk_id").distinct().agg(F.count("*").alias("agreed"))
    total = a.select("hunk_id").union(b.select("hunk_id")).distinct().agg(F.count("*").alias("total"))
    return agreed.crossJoin(total).select("agreed", "total", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("agreed") / F.col("total"), 6)).alias("agreement"))  # one row each


def orphans(pairs: DataFrame, paired: DataFrame, flows_a: DataFrame, flows_b: DataFrame) -> DataFrame:
    """(side, flow, hunks, nearest, jaccard): flows of either side left without a partner, their number of hunks, and the most
    similar flow of the other side (ties: the last name). Where nothing is shared that is the last flow of the other
    side, at 0; null only if there is none."""

    def side(own: DataFrame, other: DataFrame, mine: str, theirs: str) -> DataFrame:
        alone = own.select("flow", "hunk_id").distinct().groupBy("flow").agg(F.count("*").alias("hunks")).join(paired.select(F.col(mine).alias("flow")), "flow", "left_anti")
        best = pairs.groupBy(F.col(mine).alias("flow")).agg(F.max(F.struct("jaccard", theirs)).alias("m"))
        last = other.agg(F.max("flow").alias("last"))  # one row
        both = alone.join(best, "flow", "left").crossJoin(F.broadcast(last))
        return both.select(F.lit(mine[-1]).alias("side"), "flow", "hunks", F.coalesce(F.col("m")[theirs], "last").alias("nearest"), F.coalesce("m.jaccard", F.lit(0.0)).alias("jaccard"))

    return side(flows_a, flows_b, "flow_a", "flow_b").union(side(flows_b, flows_a, "flow_b", "flow_a"))
