"""Searches, rendered texts, memberships and names on literal inputs."""

from pyspark.sql import functions as F

from snapdelta.functions import text as tx
from snapdelta.operators import diff, listing, transcripts
from snapdelta.sources import tree


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_scopes_and_pages(spark):
    files = spark.createDataFrame([(f, "x") for f in ("src/a.ts", "src/b/c.TSX", "src2/a.ts", "src/b/d.rs", "README.md")], "file string, content string")
    names = lambda df: {r.file for r in df.collect()}
    assert names(tree.scoped(files, path="src/")) == {"src/a.ts", "src/b/c.TSX", "src/b/d.rs"}
    assert names(tree.scoped(files, path="README.md")) == {"README.md"} and len(names(tree.scoped(files, path="."))) == 5
    assert names(tree.scoped(files, kind="ts")) == {"src/a.ts", "src/b/c.TSX", "src2/a.ts"}
    assert names(tree.scoped(files, glob="*.rs")) == {"src/b/d.rs"} and names(tree.scoped(files, glob="src/*.ts")) == {"src/a.ts"}
    assert [r.file for r in tree.glob_page(files, "**/*.ts", head=1, offset=1).collect()] == ["src2/a.ts"]


def test_matches_over_lines(spark):
    files = spark.createDataFrame([("f", "one\ntwo (\n  three)\nfour ()\n"), ("g", ""), ("h", None)], "file string, content string")
    got = pairs(tree.grep_multiline(files, r"\(.*?\)"))
    assert got == {("f", 2, 3, "(\n  three)"), ("f", 4, 4, "()")}
    assert pairs(tree.grep_multiline(files, tree.any_case("ONE.TWO")).select("line", "last_line")) == {(1, 2)}


def test_rendered_flow_and_intent(spark):
    flows = spark.createDataFrame([("f", "Name", "why"), ("g", "Bare", "")], "flow string, name string, rationale string")
    entities = spark.createDataFrame([("f", "b", False), ("f", "a", False), ("f", "hand", True)], "flow string, entity string, extra boolean")
    hunks = spark.createDataFrame([("f", "h2"), ("f", "h1")], "flow string, hunk_id string")
    got = dict(pairs(transcripts.rendered_flows(flows, entities, hunks, spark.createDataFrame([("h1", "call")], "hunk_id string, kind string"))))
    assert got["f"] == "  id: f\n  name: Name\n  rationale: why\n  entities: a, b\n  extra_entities: hand\n  hunks:\n    - h1 (call)\n    - h2 (missing)\n"
    assert got["g"] == "  id: g\n  name: Bare\n  rationale: \n"
    rows = spark.createDataFrame([("T", None, []), ("T", "S", [("test", "it runs", ""), ("bench", "fast", "2x")])], "t string, s string, c array<struct<evidence_type: string, statement: string, detail: string>>")
    said = [r[0] for r in rows.select(transcripts.rendered_intent(F.col("t"), F.col("s"), F.col("c"))).collect()]
    assert said == ["  title: T\n", "  title: T\n  summary: S\n  claims:\n    0. [test] it runs\n    1. [bench] fast — 2x\n"]


def test_memberships(spark):
    schema = "g array<struct<label: string, sample_entities: array<string>>>, e array<struct<from: string, to: string>>, s array<struct<kind: string>>, m array<string>"
    row = ([(" ", ["a"]), ("ok", ["A.b", "", "src/x", "y.ts", " "])] + [(f"g{i}", []) for i in range(12)], [("a", "b"), ("a", "x.rs"), ("", "b"), ("a/b", "c")], [("queue",), ("",)], [None, "a", "\n", "b.jsx"])
    r = spark.createDataFrame([row], schema).select(tx.clean_groups(F.col("g")).alias("g"), tx.clean_edges(F.col("e")).alias("e"), tx.clean_shapes(F.col("s")).alias("s"), tx.clean_members(F.col("m")).alias("m")).first()
    assert len(r.g) == 10 and r.g[0].label == "ok" and r.g[0].sample_entities == ["A.b"]
    assert [tuple(x) for x in r.e] == [("a", "b")] and [x.kind for x in r.s] == ["queue"] and r.m == ["a"]


def test_names_of_declarations(spark):
    rows = spark.createDataFrame([("api-endpoint", "n", "GET", "/x"), ("file", "n", None, "src/a.ts"), ("function", "f", None, None)], "kind string, name string, method string, path string")
    name = lambda v: [r[0] for r in rows.select(tx.qualified_name(*map(F.col, rows.columns), variant=v)).collect()]
    assert name("full") == ["GET /x", "src/a.ts", "f"] and name("no-files") == ["GET /x", None, "f"] and name("paths") == ["/x", "src/a.ts", "f"]
    nodes = rows.withColumn("file", F.lit("src/a.ts")).withColumn("signature", F.lit("f()"))
    assert {(r.id, r.signature, r.span) for r in listing.descriptors(nodes, "head").collect()} == {("GET /x", None, None), ("src/a.ts", None, None), ("f", "f()", None)}


def test_failed_runs_tell_nothing(spark):
    base = spark.createDataFrame([(1, "e1"), (2, "e1"), (3, "e1")], "analysis long, code string")
    head = spark.createDataFrame([(1, "e2"), (2, "e2"), (3, "e1")], "analysis long, code string")
    runs = spark.createDataFrame([(1, "base", True), (1, "head", True), (2, "base", True), (2, "head", False), (3, "base", True)], "analysis long, side string, ok boolean")
    assert pairs(diff.compared_runs(base, head, ["code"], runs)) == {(1, "e2", "new"), (1, "e1", "resolved")}
