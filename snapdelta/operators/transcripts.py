"""Recorded model output and sessions: parsing, checking, counting, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What a verdict and a proof may say, and the kinds of evidence of an intent's claim.
FITS = ("delivers", "partial", "unrelated", "no-intent")
PROOFS = ("strong", "partial", "missing", "no-intent")
EVIDENCE_TYPES = ("bench", "example", "test", "observation")


def verdicts(raw: DataFrame, text: str = "text") -> DataFrame:
    """Verdict texts as columns; what is not on the list, or no object at all, is an error instead of a value.
    Strength defaults to low and the claim's index to -1."""
    v = F.from_json(text, "struct<verdict:string,proof:string,strength:string,claim_index:bigint>")
    rows = raw.withColumn("_v", v)
    bad = F.when(F.col("_v").isNull() | F.coalesce("_v.verdict", "_v.proof").isNull(), "NOT_A_VERDICT").when(~F.coalesce(F.col("_v.verdict").isin(*FITS), F.lit(True)), "UNKNOWN_VERDICT").when(~F.coalesce(F.col("_v.proof").isin(*PROOFS), F.lit(True)), "UNKNOWN_PROOF")
    rows = rows.withColumn("error", bad)
    good = lambda c: F.when(F.col("error").isNull(), c)
    return rows.select(*[c for c in raw.columns if c != text], good(F.col("_v.verdict")).alias("verdict"), good(F.col("_v.proof")).alias("proof"), good(F.coalesce("_v.strength", F.lit("low"))).alias("strength"), good(F.coalesce("_v.claim_index", F.lit(-1).cast("long"))).alias("claim_index"), "error")


def intent_claims(raw: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Claims of intent texts, one row each: blank ones are left out, unknown evidence counts as observation."""
    claims = F.from_json(text, "struct<claims:array<struct<statement:string,evidence_type:string,detail:string>>>")["claims"]
    rows = raw.select(key, F.posexplode(F.filter(claims, lambda c: F.trim(c["statement"]) != "")).alias("claim_index", "c"))
    kind = F.when(F.col("c.evidence_type").isin(*EVIDENCE_TYPES), F.col("c.evidence_type")).otherwise("observation")
    return rows.select(key, "claim_index", F.col("c.statement").alias("statement"), kind.alias("evidence_type"))


def intent_source(files: DataFrame) -> DataFrame:
    """(…, path, text) of intent files: JSON files are structured and say their title, others are raw text as it is;
    no text, or JSON without a title, gives nulls."""
    structured = F.lower("path").endswith(".json")
    said = F.when(structured, F.get_json_object("text", "$.title")).otherwise(F.col("text"))
    shape = F.when(said.isNotNull(), F.when(structured, "structured").otherwise("raw"))
    return files.select(*[c for c in files.columns if c not in ("path", "text")], shape.alias("shape"), said.alias("said"))


def touched_entities(results: DataFrame, key: str) -> DataFrame:
    """(key, tool, argument, result): the entities that a tool call touched; unreadable results touch none."""
    v = F.try_parse_json("result")
    names = lambda path: F.try_variant_get(v, path, "array<struct<name:string>>")
    listed = F.when(F.col("tool") == "get_entity", F.array("argument")).when(F.col("tool") == "neighbors", F.transform(names("$.nodes"), lambda x: x["name"])).when(F.col("tool") == "list_entities", F.transform(names("$"), lambda x: x["name"]))
    return results.select(key, "tool", F.explode(F.array_distinct(F.filter(listed, lambda x: x.isNotNull()))).alias("entity"))


def responses(rows: DataFrame) -> DataFrame:
    """Model answers: reasoning stands in for an empty content without tool calls, unreadable arguments are {}, and
    missing counts are 0."""
    empty = F.coalesce(F.trim("content"), F.lit("")) == ""
    content = F.when(empty & (F.coalesce("tool_calls", F.lit(0)) == 0), F.col("reasoning")).otherwise(F.col("content"))
    arguments = F.when(F.try_parse_json("arguments").isNotNull(), F.col("arguments")).otherwise("{}")
    return rows.withColumns({"content": content, "arguments": arguments, "tokens": F.coalesce("tokens", F.lit(0))})


def until_first_stop(turns: DataFrame, session: str, order: list[str], stop: Column, most: int) -> DataFrame:
    """The turns of a session up to and with the first that stops it, ``most`` at most; ``at_limit`` marks sessions
    that used all turns. A session's turns are few by contract."""
    w = W.partitionBy(session).orderBy(*order)
    rows = turns.withColumn("turn_no", F.row_number().over(w)).withColumn("_before", F.coalesce(F.sum(stop.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.where((F.col("_before") == 0) & (F.col("turn_no") <= most)).withColumn("at_limit", F.max("turn_no").over(W.partitionBy(session)) >= most).drop("_before")


def stuck(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, at, current): spans in which ``current`` stood still for longer than so many seconds."""
    w = W.partitionBy(key).orderBy("at", "event_id")
    moved = events.withColumn("moved", ~F.col("current").eqNullSafe(F.lag("current").over(w)))
    run = moved.withColumn("run", F.sum(F.col("moved").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    by = run.groupBy(key, "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("events"))
    return by.where(F.col("last") - F.col("first") > seconds)


def render(template: str, values: dict[str, Column]) -> Column:
    """A template with its {{names}} filled in."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value.cast("string"))
    return out


def rendered_flows(flows: DataFrame, flow_entities: DataFrame, flow_hunks: DataFrame, hunks: DataFrame) -> DataFrame:
    """(flow, text) of flows (flow, name, rationale): id, name and rationale, the entities and those named by hand
    (flow, entity, extra), and the hunks (flow, hunk_id) in order with their kind, or marked as missing where
    ``hunks`` (hunk_id, kind) has none. What a flow has none of is left out."""
    kind = flow_hunks.select("flow", "hunk_id").distinct().join(hunks.select("hunk_id", "kind").dropDuplicates(["hunk_id"]), "hunk_id", "left")
    line = F.concat(F.lit("    - "), "hunk_id", F.lit(" ("), F.coalesce("kind", F.lit("missing")), F.lit(")\n"))
    listed = kind.groupBy("flow").agg(F.array_sort(F.collect_list(F.struct("hunk_id", line.alias("line")))).alias("h"))
    named = flow_entities.groupBy("flow").agg(*(F.array_sort(F.collect_set(F.when(F.col("extra") == x, F.col("entity")))).alias(c) for x, c in ((False, "e"), (True, "x"))))
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(c, ", "), F.lit("\n"))).otherwise("")
    said = F.when(F.size("h") > 0, F.concat(F.lit("  hunks:\n"), F.array_join(F.transform("h", lambda r: r["line"]), ""))).otherwise("")
    head = F.concat(F.lit("  id: "), "flow", F.lit("\n  name: "), "name", F.lit("\n  rationale: "), "rationale", F.lit("\n"))
    both = flows.join(named, "flow", "left").join(listed, "flow", "left")
    return both.select("flow", F.concat(head, part("  entities: ", "e"), part("  extra_entities: ", "x"), said).alias("text"))


def rendered_intent(title: Column, summary: Column, claims: Column) -> Column:
    """A structured intent as text: title, summary, and the claims (evidence_type, statement, detail) by number; empty parts
    are left out."""
    detail = lambda c: F.when(F.coalesce(c["detail"], F.lit("")) != "", F.concat(F.lit(" — "), c["detail"])).otherwise("")
    line = lambda c, i: F.concat(F.lit("    "), i.cast("string"), F.lit(". ["), c["evidence_type"], F.lit("] "), c["statement"], detail(c), F.lit("\n"))
    told = F.when(F.size(claims) > 0, F.concat(F.lit("  claims:\n"), F.array_join(F.transform(claims, line), ""))).otherwise("")
    return F.concat(F.lit("  title: "), title, F.lit("\n"), F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("  summary: "), summary, F.lit("\n"))).otherwise(""), told)


def raw_intent(text: Column) -> Column:
    return F.concat(F.lit("(raw text intent — synthesise claims if no structure below)\n"), F.regexp_replace(text, r"^\s+|\s+$", ""))


def by_longest_prefix(rows: DataFrame, defaults: DataFrame, column: str) -> DataFrame:
    """Rows with the default (prefix, value) of the longest prefix of a column: its prefixes are listed and met by
    equality."""
    keys = rows.select(column).distinct()
    listed = keys.select(column, F.explode(F.transform(F.sequence(F.lit(1), F.length(column)), lambda n: F.substr(F.col(column), F.lit(1), n))).alias("prefix"))
    best = listed.join(defaults, "prefix").groupBy(column).agg(F.max_by("value", F.length("prefix")).alias("value"))
    return rows.join(best, column, "left")


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int = 64) -> DataFrame:
    """Spans (key, a_id, a_from, a_to) and (key, b_id, b_from, b_to), ends exclusive, that overlap, and where.

    Each span is listed under the cells of ``width`` that it covers; a pair is taken in the cell where its overlap
    begins, so once."""
    cells = lambda s, e: F.sequence(F.expr(f"{s} div {width}"), F.expr(f"({e} - 1) div {width}"))
    x = a.where("a_to > a_from").withColumn("cell", F.explode(cells("a_from", "a_to")))
    y = b.where("b_to > b_from").withColumn("cell", F.explode(cells("b_from", "b_to")))
    both = x.join(y, [key, "cell"]).withColumn("from", F.greatest("a_from", "b_from")).withColumn("to", F.least("a_to", "b_to"))
    return both.where((F.col("from") < F.col("to")) & (F.expr(f"`from` div {width}") == F.col("cell"))).drop("cell")
