"""Roll-ups for review: readiness, comparison of analyses, entity details, notes, changed context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .diff import keyed_diff, last_by_key


def ship_readiness(flows: DataFrame) -> DataFrame:
    """(analysis_id, flow_id, fit, proof, analysing, has_intent) to one state for each analysis and the first flow
    that keeps it from being ready."""
    bad = F.col("fit").isin("unrelated", "partial") | F.col("proof").isin("missing", "partial")
    by = flows.groupBy("analysis_id").agg(
        F.count("*").alias("flows"), F.count_if(F.col("fit") == "delivers").alias("delivers"), F.count_if(F.col("fit") == "partial").alias("partial_fit"),
        F.count_if(F.col("fit") == "unrelated").alias("unrelated"), F.count_if(F.col("proof") == "strong").alias("strong"), F.count_if(F.col("proof") == "missing").alias("missing"),
        F.min(F.when(bad, F.col("flow_id"))).alias("weakest"), F.bool_or("analysing").alias("analysing"), F.bool_and("has_intent").alias("has_intent"),
    )
    state = (
        F.when(F.col("analysing"), "pending").when(~F.col("has_intent"), "no-intent").when((F.col("strong") == F.col("flows")) & (F.col("delivers") == F.col("flows")), "ready")
        .when((F.col("missing") > 0) | (F.col("unrelated") > 0), "blocked").otherwise("caution")
    )
    return by.withColumn("state", state).drop("analysing", "has_intent")


def errored_axes(flows: DataFrame) -> DataFrame:
    """(analysis_id, proof_status, cost_status, has_membership): the axes of an analysis that failed."""
    by = flows.groupBy("analysis_id").agg(F.bool_or(F.col("proof_status") == "errored").alias("proof"), F.bool_or(F.col("cost_status") == "errored").alias("cost"), F.bool_or(~F.col("has_membership") & (F.col("proof_status") == "ready")).alias("membership"))
    parts = [F.when(F.col(c), F.lit(c)) for c in ("proof", "cost", "membership")]
    return by.select("analysis_id", F.concat_ws(",", *parts).alias("axes"))


def compare_flows(a: DataFrame, b: DataFrame, values: list[str]) -> DataFrame:
    """Flows of two analyses by name (the last of a name counts), with where each is present."""
    d = keyed_diff(last_by_key(a, ["flow"], "position"), last_by_key(b, ["flow"], "position"), ["flow"], values)
    presence = F.when(F.col("status") == "added", "only-b").when(F.col("status") == "removed", "only-a").otherwise("both")
    return d.withColumn("presence", presence).drop("status")


def pin_drift(was: DataFrame, now: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Fields of a pinned baseline that differ now (null-safe); one row for each field."""
    text = lambda df, side: df.select(*keys, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(side)) for f in fields))).alias("x")).select(*keys, "x.*")
    return text(was, "was").join(text(now, "now"), [*keys, "field"]).where(~F.col("was").eqNullSafe(F.col("now")))


def entity_detail(flow_entities: DataFrame, costs: DataFrame) -> DataFrame:
    """For each entity the flows that hold it and its even share of their cost."""
    n = flow_entities.groupBy("flow").agg(F.count("*").alias("n"))
    share = flow_entities.join(n, "flow").join(costs.select("flow", "net"), "flow", "left")
    return share.groupBy("entity").agg(F.count("*").alias("flows"), F.round(F.sum(F.coalesce(F.col("net") / F.col("n"), F.lit(0.0))), 6).alias("cost"))


def around(lines: DataFrame, keys: list[str], marked: str, n: int) -> DataFrame:
    """Lines within ``n`` of a marked one, with the number of the block of neighbouring kept lines they are in."""
    w = W.partitionBy(*keys).orderBy("line")
    near = F.max(F.col(marked).cast("int")).over(w.rowsBetween(-n, n)) == 1
    kept = lines.withColumn("kept", near)
    starts = (F.col("kept") & ~F.coalesce(F.lag("kept").over(w), F.lit(False))).cast("int")
    return kept.withColumn("block", F.sum(starts).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).where("kept").drop("kept")


def note_context(notes: DataFrame, lines: DataFrame, n: int = 5) -> DataFrame:
    """(note_id, file, at) with the lines ``n`` around it, the line itself marked. Lines are met by number: each
    note asks for the few it needs."""
    want = notes.select("note_id", "file", "at", F.explode(F.sequence(F.col("at") - n, F.col("at") + n)).alias("line"))
    got = want.join(lines.select("file", "line", "content"), ["file", "line"])
    text = F.concat(F.when(F.col("line") == F.col("at"), "> ").otherwise("  "), F.col("line").cast("string"), F.lit(" "), F.col("content"))
    by = got.groupBy("note_id", "file", "at").agg(F.array_sort(F.collect_list(F.struct("line", text.alias("t")))).alias("x"))
    out = by.select("note_id", "file", "at", F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("context"))
    return notes.select("note_id", "file", "at").join(out, ["note_id", "file", "at"], "left").withColumn("missing", F.col("context").isNull())


def deliverers(flow_entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Flow entities whose name occurs anywhere in a detail or a path of the flow's evidence (flow, detail, path).

    Texts and names meet within a flow only, each text against the flow's own names."""
    names = flow_entities.select("flow", "entity").distinct()
    texts = evidence.select("flow", F.concat_ws("\n", "detail", "path").alias("text"))
    return texts.join(names, "flow").where(F.contains("text", "entity")).select("flow", "entity").distinct()


def notes_by_line(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows of a diff (file, base_line, head_line) with the notes on either line: (note_id, file, line_side, line)."""
    sides = F.array(F.struct(F.lit("base").alias("line_side"), F.col("base_line").alias("line")), F.struct(F.lit("head").alias("line_side"), F.col("head_line").alias("line")))
    at = rows.select("file", "base_line", "head_line", F.explode(sides).alias("s")).select("file", "base_line", "head_line", "s.*").where("line is not null")
    return at.join(notes.select("note_id", "file", "line_side", "line"), ["file", "line_side", "line"]).select("file", "base_line", "head_line", "note_id")


def note_targets(notes: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Notes (note_id, anchor, target) with what they are about: ``targets`` gives (target, label) for each kind of
    anchor. A target that is gone, or a kind without a table, is marked as missing."""
    all_ = None
    for anchor, df in targets.items():
        one = df.select(F.lit(anchor).alias("anchor"), F.col("target").cast("string").alias("target"), "label")
        all_ = one if all_ is None else all_.union(one)
    known = all_.groupBy("anchor", "target").agg(F.min("label").alias("label"))
    return notes.join(known, ["anchor", "target"], "left").withColumn("missing", F.col("label").isNull())


def export_document(context: DataFrame, key: str) -> DataFrame:
    """One JSON document of notes for each ``key``: its notes in order of note_id, null fields left out."""
    fields = [c for c in context.columns if c != key]
    notes = F.array_sort(F.collect_list(F.struct("note_id", *(c for c in fields if c != "note_id"))))
    return context.groupBy(key).agg(F.count("*").alias("n"), F.to_json(F.struct(F.col(key), notes.alias("notes"))).alias("json"))


def searched(rows: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows of a diff whose text holds the query, whatever its case; all rows if it is blank. Skipped blocks have none."""
    q = query.strip().lower()
    return rows.where(F.contains(F.lower(text), F.lit(q))) if q else rows


def relabelled(rows: DataFrame, gone: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Statuses that are still being worked out, of rows whose job is gone, as errored; others stay."""
    lost = rows.join(gone.select(*keys).distinct().withColumn("_lost", F.lit(True)), keys, "left")
    for c in columns:
        lost = lost.withColumn(c, F.when(F.col("_lost") & (F.col(c) == "analyzing"), "errored").otherwise(F.col(c)))
    return lost.drop("_lost")


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
