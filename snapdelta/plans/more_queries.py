"""Registered queries of listings, labels, sessions, settings and changes, beside their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import flows, graph, listing, review, state, transcripts
from ..sources import reports, tree
from ..streaming import inflight, merge
from .queries import big, query
from .views import Tables
from .written import steps_folder

# ---- listings ---------------------------------------------------------------------------------------------------


def _both(t: Tables) -> DataFrame:
    return t.nodes("base").withColumn("side", F.lit("base")).unionByName(t.nodes("head").withColumn("side", F.lit("head")))


@query("nodes_head", """SELECT name AS id, kind, name, file, 'head' AS side, CASE WHEN kind = 'function' THEN signature END AS signature, node_id * 10 AS span_start, node_id * 10 + 5 AS span_end FROM nodes_head UNION ALL
SELECT DISTINCT 'GET /' || file, 'api-endpoint', 'GET /' || file, file, 'head', NULL, NULL, NULL FROM nodes_head UNION ALL SELECT DISTINCT file, 'file', file, file, 'head', NULL, NULL, NULL FROM nodes_head""")
def q_descriptors(t: Tables) -> DataFrame:
    own = t.nodes("head").withColumn("span", F.struct((F.col("node_id") * 10).alias("start"), (F.col("node_id") * 10 + 5).alias("end")))
    files = own.select("file").distinct()
    other = files.select("file", F.lit("api-endpoint").alias("kind"), F.lit("GET").alias("method"), F.concat(F.lit("/"), "file").alias("path")).unionByName(files.select("file", F.lit("file").alias("kind")), allowMissingColumns=True)
    return listing.descriptors(own.unionByName(other, allowMissingColumns=True), "head").select("id", "kind", "name", "file", "side", "signature", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"))


@query("nodes_base nodes_head", """SELECT file, side, node_id, name, CAST(row_number() OVER (PARTITION BY file ORDER BY side <> 'head', node_id) AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS error FROM n WHERE file IN (SELECT file FROM n GROUP BY file HAVING count(*) <= 25)
UNION ALL SELECT file, NULL, NULL, NULL, count(*), 'RESULTS_TOO_LARGE' FROM n GROUP BY file HAVING count(*) > 25""", "n AS (SELECT 'base' AS side, * FROM nodes_base UNION ALL SELECT 'head', * FROM nodes_head)")
def q_entity_rows(t: Tables) -> DataFrame:
    return listing.listed(_both(t), ["file"], most=25).select("file", "side", big("node_id", "node_id"), "name", "place", "error")


@query("nodes_head", "SELECT 'nodes' AS part, kind, count(*) AS n FROM nodes_head GROUP BY kind")
def q_side_only(t: Tables) -> DataFrame:
    document = {"nodes": _both(t), "hunks": t.api_hunks(), "flows": t.flows_a()}
    shown = listing.one_side(document, "head")
    parts = [shown["nodes"].select(F.lit("nodes").alias("part"), "kind"), shown["hunks"].select(F.lit("hunks"), "status"), shown["flows"].select(F.lit("flows"), "flow")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("part", "kind").agg(F.count("*").alias("n"))


@query("edges_head", "SELECT src, dst FROM edges_head WHERE src IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def q_edges_from(t: Tables) -> DataFrame:
    return graph.edges_from(t.edges("head"), t.part.where("p_size = 7").select(F.col("p_partkey").alias("node"))).select("src", "dst")


@query("nodes_head", "SELECT p_partkey AS node_id, n.name FROM part LEFT JOIN nodes_head n ON n.node_id = p_partkey")
def q_nodes_by_id(t: Tables) -> DataFrame:
    return graph.by_id(t.nodes("head"), t.part.select(F.col("p_partkey").alias("node_id"))).select("node_id", "name")


# ---- names and labels ----------------------------------------------------------------------------------------------


@query("nodes_base", "SELECT node_id, string_split(name, '.')[-1] AS tail, CAST(length(string_split(name, '.')[-1]) AS BIGINT) AS highlight, CASE kind WHEN 'type' THEN name ELSE 'GET /' || file END AS qualified FROM nodes_base")
def q_name_parts(t: Tables) -> DataFrame:
    name = F.col("name")
    kind = F.when(F.col("kind") == "type", "type").otherwise("api-endpoint")
    qualified = tx.qualified_name(kind, name, F.lit("GET"), F.concat(F.lit("/"), "file"))
    return t.nodes("base").select("node_id", tx.last_segment(name).alias("tail"), big(tx.highlight_length(name), "highlight"), qualified.alias("qualified"))


_SLICE = "SELECT doc_id, text, CAST(length(text) // 3 AS INTEGER) AS f, instr(substr(text, CAST(length(text) // 3 AS INTEGER) + 1, CAST(length(text) // 2 AS INTEGER)), 'the') AS a FROM documents WHERE text IS NOT NULL"


@query("", f"SELECT doc_id, CAST(length(p) - length(replace(p, chr(10), '')) AS BIGINT) AS line, CAST(length(string_split(p, chr(10))[-1]) AS BIGINT) AS col FROM (SELECT doc_id, substr(text, 1, CAST(f + a - 1 AS INTEGER)) AS p FROM ({_SLICE}) WHERE a > 0) WHERE NOT regexp_matches(p, '[\\x{{10000}}-\\x{{10FFFF}}]')")
def q_name_position(t: Tables) -> DataFrame:
    start = F.expr("length(text) div 3").cast("int")
    at = tx.name_position(F.col("text"), start, start + F.expr("length(text) div 2").cast("int"), F.lit("the"))
    return t.documents.where("text is not null").select("doc_id", at.alias("at")).where("at is not null").select("doc_id", big("at.line", "line"), big("at.col", "col"))


@query("", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'C:' || chr(92) || 'x' || chr(92) || 'repository-' || page_id WHEN 1 THEN 'ab' || page_id ELSE '/tmp/head' END AS sha, page_id % 3 <> 1 AS is_path, CASE page_id % 3 WHEN 0 THEN CASE WHEN length('repository-' || page_id) > 12 THEN substr('repository-' || page_id, 1, 12) || '…' ELSE 'repository-' || page_id END WHEN 1 THEN 'ab' || page_id ELSE 'head' END AS short FROM pages")
def q_commit_labels(t: Tables) -> DataFrame:
    p = F.col("page_id").cast("string")
    sha = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("C:\\x\\repository-"), p)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("ab"), p)).otherwise("/tmp/head")
    return t.pages.select("page_id", sha.alias("sha")).select("page_id", "sha", tx.is_path_id(F.col("sha")).alias("is_path"), tx.short_id(F.col("sha")).alias("short"))


@query("", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Flow ' || p_size WHEN 1 THEN 'Top-level' ELSE p_brand END AS label FROM part")
def q_flow_labels(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit("<structural:  flow "), F.col("p_size").cast("string"), F.lit(">"))).when(k == 1, "top-level").otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", tx.flow_label(name).alias("label"))


@query("", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'own.er/re-po #' || page_id WHEN 1 THEN 'owner/repo' ELSE 'local · ' || substr(sha256(url), 1, 8) END AS label FROM pages")
def q_row_label(t: Tables) -> DataFrame:
    k = F.col("page_id") % 4
    repo = F.when(k == 0, F.concat(F.lit(" own.er/re-po #"), F.col("page_id").cast("string"))).when(k == 1, "owner/repo").when(k == 2, "head dir/of")
    return t.pages.select("page_id", tx.row_label(repo, F.sha2("url", 256)).alias("label"))


@query("", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'my-repo #' || page_id WHEN 1 THEN 'my-repo' END AS slug, CASE WHEN page_id % 2 = 0 THEN 'Add retry ' || page_id ELSE 'Fix it' END AS title FROM pages")
def q_slugs(t: Tables) -> DataFrame:
    k, p = F.col("page_id") % 4, F.col("page_id").cast("string")
    side = lambda s: F.when(k == 0, F.concat(F.lit(f"my-repo-{s}-"), p)).when(k == 1, f"my-repo-{s}").when(k == 2, f"{s}-{s}").otherwise("same")
    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("pr-0001-add-retry-"), p)).otherwise("pr-77-fix-it")
    return t.pages.select("page_id", tx.pair_slug(side("base"), side("head")).alias("slug"), tx.slug_title(title).alias("title"))


@query("", "SELECT page_id, '{\"u\": \"http://x//' || page_id || '\", \"n\": 1 ' || chr(10) || '}' AS plain, CAST(1 AS BIGINT) AS n FROM pages")
def q_json_comments(t: Tables) -> DataFrame:
    text = F.concat(F.lit('{"u": "http://x//'), F.col("page_id").cast("string"), F.lit('", "n": 1 // a "note"\n}'))
    plain = tx.without_comments(text)
    return t.pages.select("page_id", plain.alias("plain"), F.get_json_object(plain, "$.n").cast("long").alias("n"))


@query("", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'other.list' ELSE 'tool.list' END AS tool, CASE WHEN event_id % 2 = 0 THEN 'ERROR: NOT_FOUND' || chr(10) || '{\"code\":\"NOT_FOUND\",\"message\":\"no ' || event_id || '\"}' END AS answer, event_id % 2 = 0 AS is_error FROM events")
def q_tool_answers(t: Tables) -> DataFrame:
    e = F.col("event_id")
    name = F.get(F.array(*map(F.lit, ("tool.list", "tool:list", "old:list", "other.list"))), (e % 4).cast("int"))
    answer = tx.error_envelope(F.when(e % 2 == 0, "NOT_FOUND"), F.concat(F.lit("no "), e.cast("string")))
    return t.events.select("event_id", tx.canonical_tool(name, "tool", ("old",)).alias("tool"), answer["text"].alias("answer"), answer["is_error"].alias("is_error"))


@query("", "SELECT p_partkey, concat_ws('/', replace(replace(p_name, '/', '__'), ':', '__'), p_type || '__' || p_size) AS folder FROM part")
def q_stored_path(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.stored_path(F.col("p_name"), F.concat("p_type", F.lit(":"), F.col("p_size").cast("string"))).alias("folder"))


# ---- inputs of passes ------------------------------------------------------------------------------------------------


@query("", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'structured' WHEN page_id % 3 = 1 THEN 'raw' END AS shape, CASE WHEN page_id % 3 = 0 THEN 'T' || page_id WHEN page_id % 3 = 1 THEN '# T' || page_id || chr(10) || chr(10) || '<' || url || '>' || chr(10) || chr(10) || 'body' END AS said FROM pages")
def q_intent_source(t: Tables) -> DataFrame:
    k, p = F.col("page_id") % 3, F.col("page_id").cast("string")
    title = F.when(k < 2, F.concat(F.lit(" T"), p)).otherwise(" ")
    path = F.when(k == 0, "intent.JSON").otherwise("intent.txt")
    text = F.when(k == 0, F.to_json(F.struct(F.concat(F.lit("T"), p).alias("title")))).otherwise(tx.intent_text(title, F.when(k == 1, F.col("url")), F.when(k == 1, "body ")))
    return transcripts.intent_source(t.pages.select("page_id", path.alias("path"), text.alias("text"))).select("page_id", "shape", "said")


@query("", """SELECT doc_id, 'Commit messages between base and head:' || chr(10) || substr(trim(text), 1, 8000) || chr(10) || chr(10) || 'README excerpt (for project vocabulary):' || chr(10) || array_to_string(string_split(text, chr(10))[1:40], chr(10)) || chr(10) || chr(10) || 'Changed files:' || chr(10) || array_to_string(list_transform(range(1, least(n, 60) + 1), lambda i: '  ' || i || '. f' || i || chr(10)), '') || CASE WHEN n > 60 THEN '  … (' || (n - 60) || ' more)' || chr(10) ELSE '' END AS prompt
FROM (SELECT *, doc_id % 90 + 1 AS n FROM documents WHERE trim(text) <> '')""")
def q_intent_inputs(t: Tables) -> DataFrame:
    changed = F.transform(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 90 + 1), lambda i: F.concat(F.lit("f"), i.cast("string")))
    return t.documents.where("trim(text) <> ''").select("doc_id", tx.intent_inputs(F.col("text"), F.col("text"), changed).alias("prompt"))


@query("", "SELECT id, CASE WHEN k % 2 = 0 THEN 'Named ' || k ELSE 'Add part ' || k END AS title, CASE WHEN k % 2 = 0 THEN 'told' ELSE 'Sample PR from ' || id || '.' END AS description, k % 3 = 0 AS has_intent FROM (SELECT p_partkey AS k, 'pr-' || p_partkey || '-add-part-' || p_partkey AS id FROM part WHERE p_partkey % 5 <> 0)")
def q_samples(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    id_ = F.concat(F.lit("pr-"), k.cast("string"), F.lit("-add-part-"), k.cast("string"))
    found = F.array_compact(F.array(F.lit("base/a.ts"), F.when(k % 5 != 0, "head/a.ts"), F.when(k % 3 == 0, "intent.json")))
    paths = t.part.select(id_.alias("id"), F.explode(found).alias("file")).select(F.concat_ws("/", "id", "file").alias("path")).union(t.part.select(F.concat_ws("/", F.lit("notes"), "p_name")))
    meta = t.part.where(k % 2 == 0).select(id_.alias("id"), F.concat(F.lit("Named "), k.cast("string")).alias("title"), F.lit("told").alias("description"))
    return tree.samples(paths, meta)


@query("", "SELECT p_partkey AS root, side, CASE WHEN p_partkey % 2 = 0 THEN 'coverage/lcov.info' ELSE 'coverage/coverage-summary.json' END AS path FROM part, (VALUES ('base'), ('head')) v(side) WHERE p_partkey % 3 <> 0")
def q_coverage_files(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    files = F.array_compact(F.array(F.lit("coverage/coverage-summary.json"), F.when(k % 2 == 0, "coverage/lcov.info"), F.lit("readme")))
    sides = F.array_compact(F.array(F.lit("base"), F.when(k % 3 != 0, "head")))
    present = t.part.select(k.alias("root"), F.explode(sides).alias("side"), files.alias("f")).select("root", "side", F.explode("f").alias("path"))
    return reports.coverage_files(present)


@query("", "SELECT scope, pass, value FROM (SELECT c_custkey AS scope, unnest(['main', 'probe', 'proof']) AS pass, unnest([CASE WHEN c_custkey % 2 = 0 THEN 'a:m1' END, CASE WHEN c_custkey % 3 = 0 THEN 'b:m2' WHEN c_custkey % 2 = 0 THEN 'a:m1' END, CASE WHEN c_custkey % 5 = 0 THEN 'c:m:3' WHEN c_custkey % 2 = 0 THEN 'a:m1' END]) AS value FROM customer) WHERE value IS NOT NULL")
def q_settings(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    named = F.array(*(F.struct(F.lit(n).alias("name"), F.when(k % m == 0, v).alias("value")) for n, m, v in (("LLM", 2, "a:m1"), ("PROBE_LLM", 3, "b:m2"), ("PROOF_LLM", 5, "c:m:3"))))
    settings = t.customer.select(k.alias("scope"), F.explode(named).alias("x")).select("scope", "x.*")
    return state.resolved_settings(settings, {"main": ["LLM"], "probe": ["PROBE_LLM", "LLM"], "proof": ["PROOF_LLM", "LLM"]})


@query("", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'zai' END AS provider, CASE c_custkey % 3 WHEN 0 THEN 'glm-' || c_custkey WHEN 1 THEN 'qwen:27b' END AS model FROM customer")
def q_provider_model(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("ZAI: glm-"), k.cast("string"))).when(k % 3 == 1, "zai:qwen:27b").otherwise("no model")
    return t.customer.select("c_custkey", tx.provider_model(said).alias("x")).select("c_custkey", "x.provider", "x.model")


# ---- calls of language servers and local calls -----------------------------------------------------------------------------


_FIRST = "fx AS (SELECT file, string_split(name, '.')[-1] AS tail, min(node_id) AS node_id FROM nodes_head WHERE kind = 'function' GROUP BY ALL)"


@query("nodes_head nodes_base", "SELECT b.node_id AS asked, fx.node_id FROM nodes_base b JOIN fx ON fx.file = b.file AND fx.tail = string_split(b.name, '.')[-1]", _FIRST)
def q_call_targets(t: Tables) -> DataFrame:
    asked = t.nodes("base").select(F.col("node_id").alias("asked"), "file", tx.last_segment(F.col("name")).alias("name"))
    return tree.call_targets(asked, t.nodes("head")).select("asked", "node_id")


#: Four analyses: one whose server failed, one that had no answer, two that had; every ninth call is of oneself.
_SERVER = """e AS (SELECT src % 4 AS analysis, src, dst, CASE WHEN dst % 3 = 0 THEN 'defines' ELSE 'calls' END AS kind FROM edges_base),
a AS (SELECT src % 4 AS analysis, src, CASE WHEN dst % 9 = 0 THEN src ELSE dst END AS dst FROM edges_head WHERE src % 4 <> 1)"""


@query("edges_base edges_head", "SELECT * FROM e WHERE kind = 'defines' OR analysis = 0 UNION ALL SELECT DISTINCT analysis, src, dst, 'calls' FROM a WHERE analysis <> 0 AND src <> dst", _SERVER)
def q_replaced_calls(t: Tables) -> DataFrame:
    of = F.col("src") % 4
    edges = t.edges("base").select(of.alias("analysis"), "src", "dst", F.when(F.col("dst") % 3 == 0, "defines").otherwise("calls").alias("kind"))
    answers = t.edges("head").where(of != 1).select(of.alias("analysis"), "src", F.when(F.col("dst") % 9 == 0, F.col("src")).otherwise(F.col("dst")).alias("dst"))
    runs = t.region.where("r_regionkey < 4").select(F.col("r_regionkey").cast("long").alias("analysis"), (F.col("r_regionkey") != 0).alias("ok"))
    return tree.replaced_calls(edges, answers.union(answers), runs)


_LOCAL_CALLS = """f AS (SELECT file, name, min(node_id) AS id FROM nodes_head WHERE kind = 'function' GROUP BY ALL),
c AS (SELECT s.file, s.name AS caller, CASE WHEN e.src % 2 = 0 THEN t.name ELSE split_part(s.name, '.', 1) || '.' || string_split(t.name, '.')[-1] END AS meant FROM edges_head e JOIN nodes_head s ON s.node_id = e.src JOIN nodes_head t ON t.node_id = e.dst AND t.file = s.file)"""


@query("edges_head nodes_head", "SELECT x.id AS src, y.id AS dst, count(*) AS sites FROM c JOIN f x ON x.file = c.file AND x.name = c.caller JOIN f y ON y.file = c.file AND y.name = c.meant WHERE x.id <> y.id GROUP BY ALL", _LOCAL_CALLS)
def q_local_calls(t: Tables) -> DataFrame:
    n = t.nodes("head")
    s, d = n.select(F.col("node_id").alias("src"), "file", F.col("name").alias("caller")), n.select(F.col("node_id").alias("dst"), "file", F.col("name").alias("full"))
    own = F.col("src") % 2 == 0
    calls = t.edges("head").join(s, "src").join(d, ["dst", "file"])
    calls = calls.select("file", "caller", F.when(own, F.col("full")).otherwise(tx.last_segment(F.col("full"))).alias("callee"), F.when(~own, "this").alias("receiver"))
    return tree.local_calls(calls, n).groupBy("src", "dst").agg(F.count("*").alias("sites"))


@query("", "SELECT page_id, 'open' AS \"from\", 'shut' || (page_id % 3) AS \"to\" FROM pages WHERE page_id % 3 < 2")
def q_transitions(t: Tables) -> DataFrame:
    p = F.col("page_id")
    code = F.concat(F.lit('if (s === "open") { log(); return "shut'), (p % 3).cast("string"), F.lit('" }\nif (s === "odd") { t = "open" }'))
    found = tree.transition_literals(t.pages.select(p.cast("string").alias("file"), code.alias("content")))
    states = t.pages.select(p.cast("string").alias("file"), F.lit("Door").alias("state"), F.array(*map(F.lit, ("open", "shut0", "shut1"))).alias("variants"))
    return tree.transitions(found, states).select(F.col("file").cast("long").alias("page_id"), "from", "to")


# ---- searches over files -------------------------------------------------------------------------------------------------


@query("lines", "SELECT file FROM lines WHERE regexp_matches(content, 'er[a-z]*st') GROUP BY file ORDER BY file LIMIT 40 OFFSET 5")
def q_grep_files(t: Tables) -> DataFrame:
    return tree.grep_files(t.lines().withColumnRenamed("content", "text"), "er[a-z]*st", head=40, offset=5)


@query("lines", "SELECT file, line, content AS text FROM lines WHERE line BETWEEN 3 AND 6")
def q_read_lines(t: Tables) -> DataFrame:
    return tree.read_lines(t.lines().withColumnRenamed("content", "text"), 3, 4)


@query("nodes_base", "SELECT DISTINCT file FROM nodes_base WHERE regexp_full_match(file, 'src/(.*/)?(PROMO|ECONOMY)[^/]*[.]ts')")
def q_glob(t: Tables) -> DataFrame:
    return tree.matching(t.nodes("base").select("file").distinct(), "src/**/{PROMO,ECONOMY}*.ts")


@query("lines", "SELECT file, line FROM lines WHERE contains(lower(content), 'the ')")
def q_diff_search(t: Tables) -> DataFrame:
    return review.searched(t.lines(), " The" + " ", "content").where(F.contains(F.lower("content"), F.lit("the "))).select("file", "line")


# ---- changes of tables, flows and notes ------------------------------------------------------------------------------------


@query("analyses", "SELECT c_custkey AS user_id, arg_max('k' || id, (updated_at, id)) FILTER (status = 'ready') AS artifact_key FROM customer LEFT JOIN analyses ON user_id = c_custkey GROUP BY c_custkey")
def q_find_key(t: Tables) -> DataFrame:
    rows = t.analyses().withColumn("artifact_key", F.concat(F.lit("k"), F.col("id").cast("string")))
    return state.find_key(rows, t.customer.select(F.col("c_custkey").alias("user_id")), ["user_id"])


@query("analyses", "SELECT status, count(*) AS n FROM analyses WHERE user_id % 7 <> 0 GROUP BY status")
def q_deleted(t: Tables) -> DataFrame:
    a = t.analyses()
    return state.deleted(a, a.where("user_id % 7 = 0").select("id"), ["id"]).groupBy("status").agg(F.count("*").alias("n"))


@query("", "SELECT user_id, arg_max(v, event_id) AS verdict FROM (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN event_type ELSE '-' END AS v FROM events) GROUP BY user_id HAVING arg_max(v, event_id) <> '-'")
def q_verdict_set(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("verdict"), "event_id")
    return state.set_or_cleared(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "verdict", "event_id")


@query("verdicts", "SELECT flow_id, CASE WHEN analysis_id IN (3, 5) AND flow_id % 3 = 0 THEN 'errored' WHEN flow_id % 3 = 0 THEN 'analyzing' ELSE 'ready' END AS cost_status, CASE WHEN analysis_id IN (3, 5) AND flow_id % 2 = 0 THEN 'errored' WHEN flow_id % 2 = 0 THEN 'analyzing' ELSE 'ready' END AS proof_status FROM verdicts")
def q_relabelled(t: Tables) -> DataFrame:
    status = lambda n: F.when(F.col("flow_id") % n == 0, "analyzing").otherwise("ready")
    rows = t.verdicts().select("analysis_id", "flow_id", status(3).alias("cost_status"), status(2).alias("proof_status"))
    gone = rows.where("analysis_id in (3, 5)").select("analysis_id")
    return review.relabelled(rows, gone, ["analysis_id"], ["cost_status", "proof_status"]).select("flow_id", "cost_status", "proof_status")


@query("flows_a nodes_head", """SELECT flow, CASE WHEN length(flow) % 5 = 0 THEN 'NAME_TOO_SHORT' WHEN length(flow) % 5 = 1 THEN 'NAME_RESERVED' WHEN length(flow) % 5 = 2 THEN 'RATIONALE_TOO_SHORT' WHEN min(hunk_id) LIKE '%a%' THEN 'HUNK_NOT_FOUND' WHEN max(entity) LIKE '%e%' THEN 'ENTITY_NOT_FOUND' END AS error FROM flows_a GROUP BY flow""")
def q_propose(t: Tables) -> DataFrame:
    a, n = t.flows_a(), F.length("flow") % 5
    by = a.groupBy("flow").agg(F.min("hunk_id").alias("h"), F.max("entity").alias("e"))
    name, why = F.when(n == 0, "ab").when(n == 1, "Misc").otherwise("a good name"), F.when(n == 2, "").otherwise("because")
    asked = by.select("flow", name.alias("name"), why.alias("rationale"), F.array("h").alias("hunk_ids"), F.array("e").alias("extra_entities"))
    known_e = by.where("e not like '%e%'").select(F.col("e").alias("entity"))
    return flows.proposal_errors(asked, by.where("h not like '%a%'").select(F.col("h").alias("hunk_id")), known_e).select("flow", "error")


@query("flows_a", "SELECT f.flow, CASE WHEN o IS NULL THEN 'FLOW_NOT_FOUND' WHEN o > 0 THEN 'COVERAGE_BROKEN' END AS error, coalesce(o, 0) AS orphans FROM (SELECT DISTINCT flow FROM fh UNION SELECT 'nowhere') f LEFT JOIN (SELECT x.flow, count(*) FILTER (n = 1) AS o FROM fh x JOIN (SELECT hunk_id, count(*) AS n FROM fh GROUP BY hunk_id) USING (hunk_id) GROUP BY x.flow) USING (flow)", "fh AS (SELECT DISTINCT flow, hunk_id FROM flows_a UNION SELECT 'odd', hunk_id FROM flows_a WHERE length(entity) % 2 = 1)")
def q_remove_flow(t: Tables) -> DataFrame:
    a = t.flows_a()
    both = a.select("flow", "hunk_id").union(a.where("length(entity) % 2 = 1").select(F.lit("odd"), "hunk_id"))
    return flows.removal_errors(both, both.select("flow").distinct().union(t.region.where("r_regionkey = 0").select(F.lit("nowhere"))))


@query("flows_a api", """SELECT n.note_id, n.anchor, n.target, x.label, x.label IS NULL AS missing FROM n LEFT JOIN (SELECT 'flow' AS anchor, flow AS target, min(file) AS label FROM flows_a GROUP BY flow UNION ALL SELECT 'entity', entity, min(file) FROM flows_a GROUP BY entity UNION ALL SELECT 'hunk', hunk_id, min(entity) FROM flows_a GROUP BY hunk_id
UNION ALL SELECT 'claim', CAST(doc_id AS VARCHAR), source FROM documents UNION ALL SELECT 'line', 'd' || doc_id || ':1', substr(string_split(text, chr(10))[1], 1, 20) FROM documents WHERE text IS NOT NULL) x USING (anchor, target)""",
       "n AS (SELECT hunk_id AS note_id, 'hunk' AS anchor, hunk_id AS target FROM flows_a UNION ALL SELECT DISTINCT flow, 'flow', flow || CASE WHEN length(flow) % 2 = 0 THEN '' ELSE '!' END FROM flows_a UNION ALL SELECT DISTINCT entity, 'entity', entity FROM flows_a UNION ALL SELECT 'c' || doc_id, 'claim', CAST(doc_id + 1 AS VARCHAR) FROM documents UNION ALL SELECT 'l' || doc_id, 'line', 'd' || doc_id || ':' || (doc_id % 2 + 1) FROM documents)")
def q_note_anchors(t: Tables) -> DataFrame:
    a, d = t.flows_a(), F.col("doc_id").cast("string")
    note = lambda df, id_, anchor, target: df.select(id_.alias("note_id"), F.lit(anchor).alias("anchor"), target.alias("target"))
    notes = note(a, F.col("hunk_id"), "hunk", F.col("hunk_id"))
    notes = notes.union(note(a.select("flow").distinct(), F.col("flow"), "flow", F.concat("flow", F.when(F.length("flow") % 2 == 0, "").otherwise("!"))))
    notes = notes.union(note(a.select("entity").distinct(), F.col("entity"), "entity", F.col("entity")))
    notes = notes.union(note(t.documents, F.concat(F.lit("c"), d), "claim", (F.col("doc_id") + 1).cast("string")))
    notes = notes.union(note(t.documents, F.concat(F.lit("l"), d), "line", F.concat(F.lit("d"), d, F.lit(":"), (F.col("doc_id") % 2 + 1).cast("string"))))
    first = F.left(F.split("text", "\n")[0], F.lit(20))
    targets = {
        "flow": a.select(F.col("flow").alias("target"), F.col("file").alias("label")), "entity": a.select(F.col("entity").alias("target"), F.col("file").alias("label")), "hunk": a.select(F.col("hunk_id").alias("target"), F.col("entity").alias("label")),
        "claim": t.documents.select(d.alias("target"), F.col("source").alias("label")), "line": t.documents.where("text is not null").select(F.concat(F.lit("d"), d, F.lit(":1")).alias("target"), first.alias("label")),
    }
    return review.note_targets(notes, targets).select("note_id", "anchor", "target", "label", "missing")


@query("lines", "SELECT l.file, l.line AS base_line, l.line + 1 AS head_line, n.note_id FROM lines l JOIN (SELECT doc_id AS note_id, 'd' || doc_id AS file, CASE WHEN quality = 1 THEN 'base' ELSE 'head' END AS line_side, CAST(doc_id % 4 + 1 AS BIGINT) AS line FROM labels) n ON n.file = l.file AND n.line = CASE n.line_side WHEN 'base' THEN l.line ELSE l.line + 1 END")
def q_notes_by_line(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    notes = t.labels.select(d.alias("note_id"), F.concat(F.lit("d"), d.cast("string")).alias("file"), F.when(F.col("quality") == 1, "base").otherwise("head").alias("line_side"), (d % 4 + 1).alias("line"))
    rows = t.lines().select("file", F.col("line").alias("base_line"), (F.col("line") + 1).alias("head_line"))
    return review.notes_by_line(rows, notes)


@query("", "SELECT doc_id % 20 AS pr, count(*) AS n, min('n' || doc_id) AS first_note FROM labels GROUP BY 1")
def q_notes_document(t: Tables) -> DataFrame:
    notes = t.labels.select((F.col("doc_id") % 20).alias("pr"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("note_id"), F.col("quality").cast("string").alias("context"))
    document = review.export_document(notes, "pr")
    return document.select("pr", "n", F.get_json_object("json", "$.notes[0].note_id").alias("first_note"))


@query("", "SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'view') AS viewed, arg_max(value, event_id) FILTER (event_type = 'click') AS clicked FROM events GROUP BY user_id")
def q_background_merge(t: Tables) -> DataFrame:
    said = lambda kind, name: F.when(F.col("event_type") == kind, F.col("value")).alias(name)
    rows = t.events.select("user_id", "event_id", said("view", "viewed"), said("click", "clicked"))
    return merge.merged_rows(rows, ["user_id"], ["viewed", "clicked"], "event_id")


# ---- jobs in flight, stores, workspaces -----------------------------------------------------------------------------

#: Each user's views ask for a job, clicks end the one asked for last, whether it runs or not.
_ASKED = """ev AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE event_type WHEN 'view' THEN 'start' ELSE 'end' END AS kind, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS job FROM events WHERE event_type IN ('view', 'click')),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev WHERE job IS NOT NULL),
w(user_id, i, event_id, kind, running, answer, is_new) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), FALSE FROM (SELECT DISTINCT user_id FROM o)
UNION ALL SELECT o.user_id, o.i, o.event_id, o.kind, CASE WHEN o.kind = 'end' THEN CASE WHEN o.job = w.running THEN NULL ELSE w.running END ELSE coalesce(w.running, o.job) END, CASE WHEN o.kind = 'start' THEN coalesce(w.running, o.job) END, o.kind = 'start' AND w.running IS NULL FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)"""


@query("", "SELECT CAST(user_id AS VARCHAR) AS key, event_id, CAST(answer AS VARCHAR) AS job, is_new FROM w WHERE kind = 'start'", _ASKED)
def q_inflight(t: Tables) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    job = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(order)
    asked = t.events.where("event_type in ('view', 'click')").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "view", "start").otherwise("end").alias("kind"), job.alias("job")).where("job is not null")
    return inflight.in_flight_batch(asked.select(F.col("user_id").cast("string").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "kind", F.col("job").cast("string").alias("job")))


@query("", """SELECT 'd' || x AS key, CASE WHEN quality IS NULL THEN NULL WHEN x % 3 = 0 THEN '{"doc_id":' || x || ',"toxic":' || toxic || '}' ELSE '{"doc_id":' || x || ',"quality":' || quality || '}' END AS json FROM (SELECT doc_id AS x FROM documents) LEFT JOIN labels ON doc_id = x""")
def q_document_store(t: Tables) -> DataFrame:
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key")
    folder = steps_folder(t.spark) + f"/store-{uuid.uuid4().hex}"
    state.put_documents(t.labels.select(key, F.to_json(F.struct("doc_id", "quality")).alias("json")), folder, version=1)
    state.put_documents(t.labels.where("doc_id % 3 = 0").select(key, F.to_json(F.struct("doc_id", "toxic")).alias("json")), folder, version=2)
    return state.get_documents(t.spark, folder, t.documents.select(key))


#: A workspace for each nation: suppliers and customers are packages of it, in folders that three kinds of manifest name.
_WORKSPACE = """p AS (SELECT 'n' || s_nationkey AS root, 'packages/s' || s_suppkey AS folder, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'packages/s' || s_suppkey END AS package FROM supplier WHERE s_nationkey % 3 = 0
UNION ALL SELECT 'n' || s_nationkey, 'apps/s' || s_suppkey || '/web', 'apps/s' || s_suppkey || '/web' FROM supplier WHERE s_nationkey % 3 = 1 AND s_suppkey % 4 <> 0
UNION ALL SELECT 'n' || c_nationkey, 'libs/c' || c_custkey, 'libs/c' || c_custkey FROM customer WHERE c_nationkey % 3 = 2 AND c_custkey % 10 = 0)"""


@query("", "SELECT DISTINCT root, folder, package FROM p", _WORKSPACE)
def q_workspace_globs(t: Tables) -> DataFrame:
    root = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias("root")
    s, c = F.col("s_suppkey").cast("string"), F.col("c_custkey").cast("string")
    own = t.supplier.where("s_nationkey % 3 = 0 and s_suppkey % 2 = 0").select(root("s_nationkey"), F.concat(F.lit("packages/s"), s, F.lit("/package.json")).alias("file"), F.to_json(F.struct(F.col("s_name").alias("name"))).alias("content"))
    nations = t.nation.select(root("n_nationkey"), "n_nationkey")
    kind = F.col("n_nationkey") % 3
    yaml, listed = "packages:\n  # all of them\n  - 'packages/*'  # one folder each\nother:\n  - skipped/*\n", '{"workspaces": {"packages": ["apps/s*/w?b/", "none/*"]}}'
    top = nations.where(kind < 2).select("root", F.when(kind == 0, "pnpm-workspace.yaml").otherwise("package.json"), F.when(kind == 0, yaml).otherwise(listed))
    refs = t.customer.where("c_nationkey % 3 = 2 and c_custkey % 10 = 0").groupBy(root("c_nationkey")).agg(F.array_join(F.collect_list(F.concat(F.lit('{"path": "./libs/c'), c, F.lit('"}'))), ", // next\n").alias("r"))
    config = refs.select("root", F.lit("tsconfig.json"), F.concat(F.lit('{"references": ['), "r", F.lit("]} // end")))
    files = t.supplier.select(root("s_nationkey"), F.concat(F.lit("packages/s"), s, F.lit("/src/index.ts")).alias("file"))
    files = files.union(t.supplier.where("s_suppkey % 4 <> 0").select(root("s_nationkey"), F.concat(F.lit("apps/s"), s, F.lit("/web/main.ts")))).union(t.customer.select(root("c_nationkey"), F.concat(F.lit("libs/c"), c, F.lit("/a/b.ts"))))
    manifests = own.union(top).union(config)
    return reports.workspace_packages(manifests, files)
