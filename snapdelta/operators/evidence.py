"""Claims about flows, from files, calls, signatures, tests, coverage, compilers and test runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRENGTH_RANK = {"high": 3, "medium": 2, "low": 1}


def strength_rank(strength: Column) -> Column:
    out = F.when(strength == "high", 3)
    for name in ("medium", "low"):
        out = out.when(strength == name, STRENGTH_RANK[name])
    return out.otherwise(0)


def preview(items: Column, k: int = 3) -> Column:
    """The first ``k`` in order, joined by a comma."""
    return F.array_join(F.slice(F.array_sort(items), 1, k), ",")


def file_scope(flow_files: DataFrame) -> DataFrame:
    """(flow, file): a single file is a strong sign of one concern, two or three a fair one, more a weak one."""
    n = F.col("n_files")
    by = flow_files.select("flow", "file").distinct().groupBy("flow").agg(F.count("*").alias("n_files"), preview(F.collect_list("file")).alias("preview"))
    return by.withColumn("claim", F.when(n == 1, "single-file").otherwise("cross-file")).withColumn("strength", F.when(n == 1, "high").when(n <= 3, "medium").otherwise("low"))


def call_chain(connected: DataFrame) -> DataFrame:
    """(flow, edges, connected) to strengths: one edge medium, a connected chain high, else low."""
    return connected.withColumn("strength", F.when(F.col("edges") == 1, "medium").when(F.col("connected"), "high").otherwise("low"))


def signature_tokens(signature: Column) -> Column:
    """Distinct runs of letters and digits of more than two bytes."""
    return F.array_distinct(F.filter(F.split(signature, r"[^\p{Alnum}]+"), lambda x: F.octet_length(x) > 2))


def signature_consistency(flow_signatures: DataFrame) -> DataFrame:
    """(flow, hunk_id, signature): tokens shared by all signatures of a flow of two or more."""
    n = flow_signatures.groupBy("flow").agg(F.count("*").alias("n")).where("n >= 2")
    tokens = flow_signatures.select("flow", F.explode(signature_tokens(F.col("signature"))).alias("token"))
    shared = tokens.groupBy("flow", "token").agg(F.count("*").alias("k")).join(n, "flow").where("k = n").groupBy("flow").agg(F.count("*").alias("shared"), preview(F.collect_list("token")).alias("preview"))
    out = n.join(shared, "flow", "left").select("flow", "n", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("preview", F.lit("")).alias("preview"))
    return out.withColumn("strength", F.when(F.col("shared") >= 2, "high").when(F.col("n") >= 3, "low")).where("strength is not null")


def entity_tokens(entity: Column) -> Column:
    """Distinct parts between dots, colons and spaces, in lower case, of three characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(entity), "[.: ]"), lambda x: F.length(x) >= 3))


def test_coverage(flow_entities: DataFrame, files: DataFrame) -> DataFrame:
    """(flow, entity) against (file, is_test, is_example): whether a test or else an example file is named after
    one of the flow's tokens. Names are cut into tokens too, so that the match is an equi join."""
    tokens = flow_entities.select("flow", F.explode(entity_tokens(F.col("entity"))).alias("token")).distinct()
    named = files.where("is_test or is_example").select("is_test", "is_example", F.explode(F.array_distinct(F.filter(F.split(F.lower(F.regexp_extract("file", r"[^/\\]*$", 0)), r"[^a-z0-9]+"), lambda x: F.length(x) >= 3))).alias("token"))
    hit = tokens.join(named, "token").groupBy("flow").agg(F.count_if("is_test").alias("tests"), F.count_if("is_example").alias("examples"))
    any_test = files.agg(F.coalesce(F.max(F.col("is_test").cast("int")), F.lit(0)).alias("any_test"))
    out = flow_entities.select("flow").distinct().join(hit, "flow", "left").crossJoin(F.broadcast(any_test))  # one row
    strength = F.when(F.col("tests") > 0, "high").when(F.col("examples") > 0, "high").when(F.col("any_test") == 0, "low")
    return out.select("flow", F.coalesce("tests", F.lit(0)).alias("tests"), F.coalesce("examples", F.lit(0)).alias("examples"), strength.alias("strength"))


def coverage_claims(coverage: DataFrame) -> DataFrame:
    """(file, before, after, delta) in permille: drops, a hundred or more strong, twenty or more fair."""
    d = F.col("delta")
    return coverage.where(d < 0).withColumn("strength", F.when(d <= -100, "high").when(d <= -20, "medium").otherwise("low"))


def compile_claims(flow_files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Diagnostics (file, code, line, class) of the flows' files: new ones weigh high, resolved ones medium."""
    hit = flow_files.select("flow", "file").distinct().join(diagnostics.where("class in ('new', 'resolved')"), "file")
    label = F.concat_ws(":", "file", "line", "code")
    by = hit.groupBy("flow", "class").agg(F.count("*").alias("n"), preview(F.collect_set(label)).alias("preview"))
    return by.withColumn("strength", F.when(F.col("class") == "new", "high").otherwise("medium"))


def run_claims(runs: DataFrame) -> DataFrame:
    """(kind, base_exit, head_exit): newly failing high, newly passing medium, else nothing."""
    b, h = F.col("base_exit"), F.col("head_exit")
    return runs.withColumn("strength", F.when((b == 0) & (h != 0), "high").when((b != 0) & (h == 0), "medium")).where("strength is not null")


def anchor(claims: DataFrame, nodes: DataFrame, first: int = 6) -> DataFrame:
    """(claim_id, entities) to the declaration of its first entity that has one: in head by whole name, by last
    part, then in base likewise. nodes is (side, node_id, file, name)."""
    e = claims.select("claim_id", F.posexplode(F.slice("entities", 1, first)).alias("pos", "entity"))
    side = F.when(F.col("side") == "head", 0).otherwise(2)
    whole = nodes.select(F.col("name").alias("entity"), "side", "node_id", "file", "name", side.alias("rank"))
    tail = nodes.select(F.substring_index("name", ".", -1).alias("entity"), "side", "node_id", "file", "name", (side + 1).alias("rank")).where("entity <> name")
    best = whole.union(tail).groupBy("entity").agg(F.min(F.struct("rank", "node_id", "side", "file", "name")).alias("n"))
    hit = e.join(best, "entity").groupBy("claim_id").agg(F.min(F.struct("pos", "entity", "n")).alias("m"))
    return hit.select("claim_id", "m.entity", F.col("m.n.rank").alias("rank"), F.col("m.n.side").alias("side"), F.col("m.n.file").alias("file"), F.col("m.n.node_id").alias("node_id"))


def references(claims: DataFrame, refs: DataFrame, most: int = 10) -> DataFrame:
    """(claim_id, n_refs) against found (claim_id, side, file, line): distinct places, up to ``most`` with the old."""
    place = refs.select("claim_id", "side", "file", "line").distinct()
    rank = F.row_number().over(W.partitionBy("claim_id").orderBy("side", "file", "line"))
    return place.join(claims.select("claim_id", "n_refs"), "claim_id").withColumn("r", rank).where(F.col("r") <= most - F.col("n_refs")).drop("r", "n_refs")
