"""Joins that resolve deltas, claims and notes to entities, files and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hunk_entities(hunks: DataFrame) -> DataFrame:
    """(hunk_id, entity) of ``described`` deltas: both ends of changed calls, the part after the last dot of a lock's
    primitive, else the declaration that a delta is about."""
    own = F.when(F.col("kind") == "lock", F.substring_index("name", ".", -1)).otherwise(F.col("name"))
    return hunks.select("hunk_id", F.explode(F.array_compact(F.array(own, F.col("callee")))).alias("entity")).distinct()


def session_entities(hunks: DataFrame) -> DataFrame:
    """(hunk_id, entity) as a session names them: locks, data shapes and docs by file and name; not made distinct."""
    own = F.when(F.col("kind").isin("lock", "data", "docs"), F.concat_ws(":", "file", "name")).otherwise(F.col("name"))
    return hunks.select("hunk_id", F.explode(F.array_compact(F.array(own, F.col("callee")))).alias("entity"))


def hunk_files(hunks: DataFrame) -> DataFrame:
    """(hunk_id, file) of ``described`` deltas: the file of the declaration, and of a changed call the caller's."""
    return hunks.select("hunk_id", "file").distinct()


def per_file(hunk_files_: DataFrame, flow_hunks: DataFrame) -> DataFrame:
    """(file, hunks, flows): how many hunks touch a file, each once, and how many flows hold one of them."""
    n = hunk_files_.groupBy("file").agg(F.count("*").alias("hunks"))
    flows = hunk_files_.join(flow_hunks.select("flow", "hunk_id").distinct(), "hunk_id").groupBy("file").agg(F.countDistinct("flow").alias("flows"))
    return n.join(flows, "file", "left").select("file", "hunks", F.coalesce("flows", F.lit(0)).alias("flows"))


def flows_touching(flow_entities: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(flow, file): flows with an entity that is the name of a head declaration in one of ``files``."""
    named = nodes.select(F.col("name").alias("entity"), "file").distinct().join(files.select("file").distinct(), "file", "left_semi")
    return flow_entities.select("flow", "entity").distinct().join(named, "entity").select("flow", "file").distinct()


def flows_of_failures(flow_entities: DataFrame, nodes: DataFrame, failing: DataFrame) -> DataFrame:
    """The flows that a failed run concerns: those that touch a failing file, or all of them if no file is named."""
    every = flow_entities.select("flow").distinct()
    none = failing.select("file").agg(F.count("*").alias("n"))
    touched = flows_touching(flow_entities, nodes, failing).select("flow", F.lit(True).alias("touched")).distinct()
    return every.join(touched, "flow", "left").crossJoin(F.broadcast(none)).where("touched or n = 0").select("flow")  # one row


def touched_lines(spans: DataFrame) -> DataFrame:
    """A row for each line of (first, last)."""
    return spans.withColumn("line", F.explode(F.sequence("first", "last"))).drop("first", "last")


def flow_hits(flow_files: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """How many rows lie in the files of each flow."""
    return flow_files.select("flow", key).distinct().join(rows, key).groupBy("flow").agg(F.count("*").alias("hits"))


def claim_proof(claims: DataFrame, proofs: DataFrame) -> DataFrame:
    """Claims (analysis_id, claim_index, …) with the proof of the same index, or else the proof at that place among the
    analysis' proofs (by ``position``, from 0); ``by_index`` tells which. Other columns of ``claims`` stay."""
    rest = [c for c in claims.columns if c not in ("analysis_id", "claim_index")]
    own = proofs.groupBy("analysis_id", "claim_index").agg(F.min_by("proof", "position").alias("own"))
    placed = proofs.select("analysis_id", F.col("position").alias("claim_index"), F.col("proof").alias("placed"))
    both = claims.join(own, ["analysis_id", "claim_index"], "left").join(placed, ["analysis_id", "claim_index"], "left")
    return both.select("analysis_id", "claim_index", *rest, F.coalesce("own", "placed").alias("proof"), F.col("own").isNotNull().alias("by_index"))


def passages_found(passages: DataFrame, docs: DataFrame, width: int = 16) -> DataFrame:
    """(item_id, doc_id) where a document holds a passage word for word.

    A passage's first words are hashed and met with the word runs of the same length, the passage itself is then
    looked for. Passages of one or two words are met by their first characters in the same way."""
    lead = F.split(F.trim("text"), r"\s+")
    p = passages.select("item_id", F.col("text").alias("passage"), F.least(F.size(lead), F.lit(width)).alias("k"), F.xxhash64(F.slice(lead, 1, width)).alias("h"))
    sizes = [r[0] for r in p.select("k").distinct().collect()]  # at most ``width`` values
    words = docs.select("doc_id", "text", F.split(F.trim("text"), r"\s+").alias("w"))
    inner = p.where("k > 2")  # the first word may follow other characters; words 2.. are whole
    tail = inner.select("item_id", "passage", "k", F.xxhash64(F.slice(F.split(F.trim("passage"), r"\s+"), 2, F.col("k") - 2)).alias("h"))
    runs = None
    for k in sizes:
        if k > 2:
            n = k - 2
            one = words.where(F.size("w") >= n).select("doc_id", F.lit(k).alias("k"), F.explode(F.array_distinct(F.expr(f"transform(sequence(1, size(w) - {n - 1}), i -> xxhash64(slice(w, i, {n})))"))).alias("h"))
            runs = one if runs is None else runs.union(one)
    found = None
    if runs is not None:
        pairs = runs.join(F.broadcast(tail) if tail.count() <= 100_000 else tail, ["k", "h"]).select("item_id", "passage", "doc_id").distinct()
        found = pairs.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    short = p.where("k <= 2 and passage is not null").select("item_id", "passage", F.slice(chars("passage"), 1, 8).alias("lead"))
    short = short.select("item_id", "passage", F.size("lead").alias("k"), F.xxhash64("lead").alias("h"))
    letters = docs.where("text is not null").select("doc_id", chars("text").alias("c"))
    for k in [r[0] for r in short.select("k").distinct().collect()]:  # 0 to 8
        starts = f"sequence(1, size(c) - {k - 1})" if k else "array(1)"
        one = letters.where(F.size("c") >= k).select("doc_id", F.explode(F.array_distinct(F.expr(f"transform({starts}, i -> xxhash64(slice(c, i, {k})))"))).alias("h"))
        pairs = one.join(short.where(F.col("k") == k), "h").select("item_id", "passage", "doc_id").distinct()
        one = pairs.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id")
        found = one if found is None else found.union(one)
    if found is None:
        return p.select("item_id").crossJoin(docs.select("doc_id")).limit(0)
    return found.distinct()
