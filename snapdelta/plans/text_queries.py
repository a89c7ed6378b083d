"""Registered queries of searches, rendered texts, memberships, transitions in source text, and runs that failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cost, diff, flows, transcripts
from ..sources import blocks, reports, tree
from .queries import _TOTALS, _probe_entities, big, joined, query
from .source_queries import _text
from .views import Tables

# ---- searches ---------------------------------------------------------------------------------------------------

_PATHS = "pa AS (SELECT doc_id, coalesce(text, '') AS text, 'docs/' || lang || '/' || CASE WHEN doc_id % 3 = 0 THEN 'deep/' ELSE '' END || 'd' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.md' ELSE '.txt' END AS file FROM documents)"


def _paths(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    ending = F.when(d % 4 == 0, ".ts").when(d % 4 == 1, ".md").otherwise(".txt")
    file = F.concat(F.lit("docs/"), "lang", F.lit("/"), F.when(d % 3 == 0, "deep/").otherwise(""), F.lit("d"), d.cast("string"), ending)
    return t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("content"), file.alias("file"))


@query("", r"""SELECT file, CAST(line AS BIGINT) AS line, CAST(line + 1 AS BIGINT) AS last_line FROM (SELECT file, i, x, 1 + coalesce(sum(length(x) - length(replace(x, chr(10), ''))) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
FROM (SELECT file, unnest(p) AS x, unnest(range(len(p))) AS i FROM (SELECT file, string_split(regexp_replace(text, '([.!?]\n[A-Z])', chr(1) || '\1', 'g'), chr(1)) AS p FROM pa WHERE file IS NOT NULL))) WHERE i > 0""", _PATHS)
def q_grep_multiline(t: Tables) -> DataFrame:
    return tree.grep_multiline(_paths(t).where("file is not null"), r"[.!?]\n[A-Z]").select("file", big("line", "line"), big("last_line", "last_line"))


@query("", "SELECT file, count(*) AS matches FROM (SELECT file, unnest(string_split(text, chr(10))) AS line FROM pa WHERE (file LIKE 'docs/en/%' AND file LIKE '%.md') OR file LIKE 'docs/fr/deep/%.t%') WHERE regexp_matches(line, '(?i)THE |LA ') GROUP BY file", _PATHS)
def q_grep_scope(t: Tables) -> DataFrame:
    files = _paths(t)
    picked = tree.scoped(files, path="docs/en", kind="md").union(tree.scoped(files, path="/docs/fr/", glob="docs/fr/deep/*.t*"))
    return tree.grep_counts(tree.lines_of(picked), tree.any_case("THE |LA "))


@query("", "SELECT file FROM pa WHERE file LIKE 'docs/en/deep/%' AND file LIKE '%.ts' ORDER BY file LIMIT 30 OFFSET 5", _PATHS)
def q_glob_page(t: Tables) -> DataFrame:
    return tree.glob_page(_paths(t), "**/*.ts", path="docs/en/deep", head=30, offset=5)


# ---- rendered texts ------------------------------------------------------------------------------------------------


@query("flows_a", """SELECT f.flow, '  id: ' || f.flow || chr(10) || '  name: ' || upper(f.flow) || chr(10) || '  rationale: of ' || n || ' rows' || chr(10) || coalesce('  entities: ' || e || chr(10), '') || coalesce('  extra_entities: ' || x || chr(10), '') || '  hunks:' || chr(10) || h AS text
FROM (SELECT flow, count(*) AS n FROM flows_a GROUP BY flow) f JOIN (SELECT flow, string_agg(entity, ', ' ORDER BY entity) FILTER (length(entity) % 2 = 0) AS e, string_agg(entity, ', ' ORDER BY entity) FILTER (length(entity) % 2 = 1) AS x FROM (SELECT DISTINCT flow, entity FROM flows_a) GROUP BY flow) USING (flow)
JOIN (SELECT flow, string_agg('    - ' || hunk_id || ' (' || CASE WHEN length(hunk_id) % 5 = 0 THEN 'missing' ELSE 'api' END || ')' || chr(10), '' ORDER BY hunk_id) AS h FROM (SELECT DISTINCT flow, hunk_id FROM flows_a) GROUP BY flow) USING (flow)""")
def q_flow_render(t: Tables) -> DataFrame:
    a = t.flows_a()
    named = a.groupBy("flow").agg(F.format_string("of %d rows", F.count("*")).alias("rationale")).select("flow", F.upper("flow").alias("name"), "rationale")
    entities = a.select("flow", "entity", (F.length("entity") % 2 == 1).alias("extra")).distinct()
    known = a.where("length(hunk_id) % 5 <> 0").select("hunk_id", F.lit("api").alias("kind"))
    return transcripts.rendered_flows(named, entities, a.select("flow", "hunk_id"), known)


@query("", """SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '(raw text intent — synthesise claims if no structure below)' || chr(10) || url ELSE '  title: ' || url || chr(10) || CASE WHEN page_id % 3 = 1 THEN '' ELSE '  summary: page ' || page_id || chr(10) || '  claims:' || chr(10) || '    0. [bench] is ' || length(html) || ' long — counted' || chr(10) || '    1. [test] ends' || chr(10) END END AS text FROM pages""")
def q_intent_render(t: Tables) -> DataFrame:
    k, p = F.col("page_id") % 3, F.col("page_id").cast("string")
    claim = lambda e, s, d: F.struct(F.lit(e).alias("evidence_type"), s.alias("statement"), F.lit(d).alias("detail"))
    claims = F.array(claim("bench", F.concat(F.lit("is "), F.length("html").cast("string"), F.lit(" long")), "counted"), claim("test", F.lit("ends"), ""))
    told = transcripts.rendered_intent(F.col("url"), F.when(k == 0, F.concat(F.lit("page "), p)), F.when(k == 0, claims))
    return t.pages.select("page_id", F.when(k == 2, transcripts.raw_intent(F.concat(F.lit("\n "), "url", F.lit("\n")))).otherwise(told).alias("text"))


@query("lines", """SELECT file, string_agg(content, '|' ORDER BY line) FILTER (line <= 12 AND k) AS samples, count(*) FILTER (line <= 12 AND k) AS edges FROM (SELECT file, line, content, regexp_matches(content, '\\S') AND NOT contains(content, '/') AND NOT regexp_matches(content, '\\.(ts|tsx|js|jsx|rs)$') AS k FROM lines) GROUP BY file""")
def q_memberships(t: Tables) -> DataFrame:
    """The first twelve lines of each document as samples of a group, as edges from the document, and as shapes."""
    by = t.lines().where("line <= 12").groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]).alias("said"))
    group = lambda label: F.struct(F.lit(label).alias("label"), F.col("said").alias("sample_entities"))
    groups = tx.clean_groups(F.array(group(" "), group("first lines")))
    edges = tx.clean_edges(F.transform("said", lambda x: F.struct(F.lit("document").alias("from"), x.alias("to"))))
    clean = by.select("file", groups[0]["sample_entities"].alias("s"), F.size(edges).alias("edges"))
    return clean.select("file", F.when(F.size("s") > 0, F.array_join("s", "|")).alias("samples"), big("edges", "edges"))


# ---- transitions, failed runs, baselines -----------------------------------------------------------------------------


def _machines(t: Tables) -> DataFrame:
    """(file, content): each part is a state of three values and a function that moves between them."""
    p = F.col("p_partkey").cast("string")
    made = _text(
        "export type M", p, ' =\n  | "a', p, '" | \'b', p, "'\n  | \"c\";\nfunction f", p, '(x: M) {\n  if (x.s === "a', p, '") {\n    if (y) { log("{", "c"); }\n    // return "c";\n    return "b', p, '";\n  } else if ("b', p, '" == x) x = "c"; else { const q = "a', p, '"; }\n  if (x === "c") { if (z) { s.t = "a', p, '"; } return "c"; }\n  if (x === "none") { return "c"; }\n}\n',
    )
    rows = t.part.select(F.format_string("src/m%d.ts", F.expr("p_partkey div 50")).alias("file"), "p_partkey", made.alias("d"))
    texts = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "d"))).alias("ds"))
    return texts.select("file", F.array_join(F.transform("ds", lambda x: x["d"]), "").alias("content"))


_MOVES = """m AS (SELECT 'src/m' || (p_partkey // 50) || '.ts' AS file, p_partkey AS p FROM part),
mv AS (SELECT file, 'a' || p AS a, 'b' || p AS b FROM m UNION ALL SELECT file, 'b' || p, 'c' FROM m UNION ALL SELECT file, 'c', 'a' || p FROM m),
ms AS (SELECT file, 'M' || p AS state, ['a' || p, 'b' || p, 'c'] AS v FROM m)"""


@query("", 'SELECT file, state, a AS "from", b AS "to" FROM mv JOIN ms USING (file) WHERE list_contains(v, a) AND list_contains(v, b)', _MOVES)
def q_state_moves(t: Tables) -> DataFrame:
    files = _machines(t)
    states = blocks.unions(files).select("file", F.col("name").alias("state"), "variants")
    return tree.transitions(tree.transition_literals(files), states)


@query("diag_base diag_head", """SELECT class, analysis, count(*) AS n FROM (SELECT 'new' AS class, line % 4 AS analysis FROM diag_head h WHERE (file, line, col, code) NOT IN (SELECT file, line, col, code FROM diag_base)
UNION ALL SELECT 'resolved', line % 4 FROM diag_base WHERE (file, line, col, code) NOT IN (SELECT file, line, col, code FROM diag_head)
UNION ALL SELECT 'persistent', line % 4 FROM diag_head WHERE (file, line, col, code) IN (SELECT file, line, col, code FROM diag_base)) WHERE analysis IN (0, 3) GROUP BY ALL""")
def q_compared_runs(t: Tables) -> DataFrame:
    """Of four analyses one has a side that failed, and one a side that did not run."""
    rows = t.region.where("r_regionkey < 4").select(F.col("r_regionkey").cast("long").alias("analysis"), F.explode(F.array(F.lit("base"), F.lit("head"))).alias("side"))
    runs = rows.where("not (analysis = 2 and side = 'head')").withColumn("ok", ~((F.col("analysis") == 1) & (F.col("side") == "base")))
    sides = [t.diagnostics(s).withColumn("analysis", F.col("line") % 4) for s in ("base", "head")]
    return diff.compared_runs(*sides, ["file", "line", "col", "code"], runs).groupBy("class", "analysis").agg(F.count("*").alias("n"))


@query("probe_e", f"""SELECT CAST(sum(tokens) FILTER (side = 'base') AS BIGINT) AS tokens_base, CAST(sum(tokens) FILTER (side = 'head') AS BIGINT) AS tokens_head, CAST(sum(cost) FILTER (side = 'base' AND probe = 'click') AS BIGINT) AS continuation, CAST(sum(cost) FILTER (side = 'base' AND probe = 'purchase') AS BIGINT) AS operational, CAST(sum(cost) FILTER (side = 'base' AND probe = 'view') AS BIGINT) AS runtime,
(SELECT arg_min('synth-' || quality, doc_id) FROM labels WHERE toxic = 0) AS synthesis_model, (SELECT arg_min('proof-' || toxic, doc_id) FROM labels WHERE quality = 1) AS proof_model FROM ({_TOTALS})""")
def q_baseline_summary(t: Tables) -> DataFrame:
    of = t.labels.select(F.col("doc_id").alias("position"), F.when(F.col("toxic") == 0, F.concat(F.lit("synth-"), F.col("quality").cast("string"))).alias("source_model"), F.when(F.col("quality") == 1, F.concat(F.lit("proof-"), F.col("toxic").cast("string"))).alias("proof_model"))
    got = cost.baseline_summary(cost.probe_totals(_probe_entities(t)), of, {"continuation": "click", "operational": "purchase", "runtime": "view"})
    return got.select(*(big(c, c) for c in ("tokens_base", "tokens_head", "continuation", "operational", "runtime")), "synthesis_model", "proof_model")


# ---- source trees that the tests alone covered -----------------------------------------------------------------------


def _imports(t: Tables) -> DataFrame:
    """(file, content): each supplier's module imports two names of the next one's, and exports two functions."""
    s = F.col("s_suppkey")
    made = F.format_string('import type { a%d as x, b%d } from "./m%d";\nimport z from "z";\nexport function a%d() {\n}\nexport function b%d(  q:   T ) {\n}\n', s + 1, s + 1, s + 1, s, s)
    return t.supplier.select(F.format_string("src/m%d.ts", s).alias("file"), made.alias("content"), "s_suppkey")


_NEXT = "n AS (SELECT s_suppkey AS s, s_suppkey + 1 AS k, s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) AS known FROM supplier)"


@query("", "SELECT 'src/m' || s || '.ts' AS file, CASE i WHEN 0 THEN 'x' ELSE 'b' || k END AS local, CASE i WHEN 0 THEN 'a' || k ELSE 'b' || k END AS imported, './m' || k AS spec FROM n, range(2) r(i)", _NEXT)
def q_imports(t: Tables) -> DataFrame:
    return tree.imports(tree.lines_of(_imports(t)))


@query("", "SELECT 'src/m' || s || '.ts' AS file, 'src/m' || k AS path, 'src/m' || k || '.ts' AS target FROM n WHERE known", _NEXT)
def q_module_targets(t: Tables) -> DataFrame:
    files = _imports(t)
    wanted = tree.imports(tree.lines_of(files)).select("file", F.concat(F.lit("src/"), F.substring("spec", 3, 1000)).alias("path")).distinct()
    return tree.resolved_modules(wanted, files.select("file"))


@query("", "SELECT 'src/m' || s || '.ts' AS caller_file, 'b' || s AS caller, 'src/m' || k || '.ts' AS file, 'a' || k AS name FROM n WHERE known", _NEXT)
def q_cross_file_calls(t: Tables) -> DataFrame:
    files = _imports(t)
    bound = tree.imports(tree.lines_of(files)).withColumn("path", F.concat(F.lit("src/"), F.substring("spec", 3, 1000)))
    bound = bound.join(tree.resolved_modules(bound.select("file", "path").distinct(), files.select("file")), ["file", "path"]).select("file", "local", "imported", "target", F.lit(0).alias("position"))
    calls = files.select(F.col("file").alias("caller_file"), F.format_string("b%d", "s_suppkey").alias("caller"), F.lit("x").alias("local"))
    return tree.cross_file_calls(calls, bound, blocks.functions(files).where("exported").select("file", "name"))


@query("", "SELECT 'src/m' || s_suppkey || '.ts' AS file, 'function b' || s_suppkey || '( q: T )' AS signature FROM supplier")
def q_signatures(t: Tables) -> DataFrame:
    found = tree.declarations(tree.lines_of(_imports(t))).where("name like 'b%'")
    return found.select("file", tx.normalised_signature(F.regexp_replace("signature", "^export ", "")).alias("signature"))


@query("", "SELECT s_suppkey, 'a,' || split_part(s_name, ' ', 1) AS params FROM supplier")
def q_doc_params(t: Tables) -> DataFrame:
    text = F.concat(F.lit("/**\n * @param {T} [a=1] x\n * @returns y\n * @param "), F.split_part("s_name", F.lit(" "), F.lit(1)), F.lit("? - z\n */"))
    return t.supplier.select("s_suppkey", joined(tx.doc_params(text), "params"))
