"""The registered queries: each operator over the driver's tables, beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cost, evidence, flows, graph, hunks, lines, resolve, review, state, transcripts
from ..operators.diff import keyed_diff, paired, row_classes
from ..session import ship_package
from ..sources import reports, tree
from ..streaming import progress
from .views import Tables, with_views
from .written import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(views: str = "", sql: str | None = None, extra: str = ""):
    """Register a function of ``Tables`` under its name, and its SQL if there is one."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(ship_package(spark), sf_dir))
        if sql:
            ORACLE[f.__name__] = with_views(views, sql, extra)
        return f

    return put


def joined(c: str, alias: str | None = None):
    """An array as one string, so that both engines give the same value."""
    return F.array_join(c, ",").alias(alias or c)


def big(c, alias: str):
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(alias)


# ---- keyed comparison of snapshots ------------------------------------------------------------------------


@query("named_base named_head", """SELECT 'added' AS change, src, dst, caller_file, caller_name, callee_name FROM named_head h WHERE NOT EXISTS (SELECT 1 FROM named_base b WHERE b.caller_file = h.caller_file AND b.caller_name = h.caller_name AND b.callee_name = h.callee_name)
UNION ALL SELECT 'removed', src, dst, caller_file, caller_name, callee_name FROM named_base b WHERE NOT EXISTS (SELECT 1 FROM named_head h WHERE b.caller_file = h.caller_file AND b.caller_name = h.caller_name AND b.callee_name = h.callee_name)""")
def q_call_delta(t: Tables) -> DataFrame:
    sides = [hunks.named_edges(t.edges(s), t.nodes(s)) for s in ("base", "head")]
    return hunks.call_delta(*sides).select("change", "src", "dst", "caller_file", "caller_name", "callee_name")


_SETS = """SELECT file, {name}, string_agg(CASE WHEN b.item IS NULL THEN h.item END, ',' ORDER BY coalesce(h.item, b.item)) AS added, string_agg(CASE WHEN h.item IS NULL THEN b.item END, ',' ORDER BY coalesce(h.item, b.item)) AS removed,
count(*) FILTER (b.item IS NULL) AS na, count(*) FILTER (h.item IS NULL) AS nr FROM {b} b FULL JOIN {h} h USING (file, {name}, item) GROUP BY ALL"""


@query("var_base var_head", f"SELECT file, name, coalesce(added, '') AS added, coalesce(removed, '') AS removed FROM ({_SETS.format(name='name', b='var_base', h='var_head')}) WHERE na + nr > 0")
def q_state_delta(t: Tables) -> DataFrame:
    return hunks.state_delta(t.variants("base"), t.variants("head")).select("file", "name", joined("added"), joined("removed"))


@query("api", "SELECT * FROM api")
def q_api_delta(t: Tables) -> DataFrame:
    return hunks.api_delta(t.nodes("base"), t.nodes("head"), t.exports(), t.exports())


def _lock(t: Tables) -> DataFrame:
    return hunks.lock_delta(*(hunks.needle_hits(t.files(s), t.needles()) for s in ("base", "head")))


@query("hits_base hits_head", "SELECT file, primitive, b.primitive2 AS before, h.primitive2 AS after FROM (SELECT DISTINCT *, primitive AS primitive2 FROM hits_base) b FULL JOIN (SELECT DISTINCT *, primitive AS primitive2 FROM hits_head) h USING (file, primitive) WHERE b.primitive2 IS NULL OR h.primitive2 IS NULL")
def q_lock_delta(t: Tables) -> DataFrame:
    return _lock(t)


@query("hits_base", "SELECT primitive, count(*) AS files FROM hits_base GROUP BY primitive")
def q_needle_hits(t: Tables) -> DataFrame:
    return hunks.needle_hits(t.files("base"), t.needles()).groupBy("primitive").agg(F.count("*").alias("files"))


@query("shape_base shape_head", f"""SELECT file, type_name, CASE WHEN na = 1 AND nr = 1 THEN '' ELSE coalesce(added, '') END AS added, CASE WHEN na = 1 AND nr = 1 THEN '' ELSE coalesce(removed, '') END AS removed,
CASE WHEN na = 1 AND nr = 1 THEN removed END AS renamed_from, CASE WHEN na = 1 AND nr = 1 THEN added END AS renamed_to FROM ({_SETS.format(name='type_name', b='shape_base', h='shape_head')}) WHERE na + nr > 0""")
def q_data_delta(t: Tables) -> DataFrame:
    return hunks.data_delta(t.shapes("base"), t.shapes("head")).select("file", "type_name", joined("added"), joined("removed"), "renamed_from", "renamed_to")


@query("shape_base shape_head", """SELECT file, type_name AS fn, CASE WHEN nb <> nh THEN 'param-count' ELSE 'param-names' END AS drift FROM (SELECT file, type_name, count(*) AS nb, string_agg(item, ',' ORDER BY item) AS xb FROM shape_base GROUP BY ALL) b
JOIN (SELECT file, type_name, count(*) AS nh, string_agg(item, ',' ORDER BY item) AS xh FROM shape_head GROUP BY ALL) h USING (file, type_name) WHERE xb <> xh""")
def q_docs_drift(t: Tables) -> DataFrame:
    b, h = t.shapes("base").withColumnRenamed("fields", "doc_params"), t.shapes("head").withColumnRenamed("fields", "sig_params")
    return hunks.docs_drift(b.join(h, ["file", "type_name"]).withColumnRenamed("type_name", "fn"))


@query("nodes_base nodes_head", "SELECT file, name, bool_or(signature LIKE 'export %' OR signature LIKE 'pub %') AS was_exported FROM nodes_base WHERE name NOT IN (SELECT name FROM nodes_head) GROUP BY file, name")
def q_deletion(t: Tables) -> DataFrame:
    return hunks.deletions(t.nodes("base"), t.nodes("head"))


def _all_hunks(t: Tables) -> DataFrame:
    named = [written(hunks.named_edges(t.edges(s), t.nodes(s)).select("src", "dst", "caller_file", "caller_name", "callee_name"), "named") for s in ("base", "head")]
    b, h = t.shapes("base").withColumnRenamed("fields", "doc_params"), t.shapes("head").withColumnRenamed("fields", "sig_params")
    return hunks.described({
        "call": hunks.call_delta(*named),
        "state": hunks.state_delta(t.variants("base"), t.variants("head")),
        "api": hunks.api_delta(t.nodes("base"), t.nodes("head"), t.exports(), t.exports()),
        "lock": _lock(t),
        "data": hunks.data_delta(t.shapes("base"), t.shapes("head")),
        "docs": hunks.docs_drift(b.join(h, ["file", "type_name"]).withColumnRenamed("type_name", "fn")),
        "deletion": hunks.deletions(t.nodes("base"), t.nodes("head")),
    })


_HUNKS = f"""hunks AS (SELECT 'call' AS kind, 0 AS kind_rank, 'call' AS hunk_id, caller_file AS file, caller_name AS name, callee_name AS callee, 1 AS added, 0 AS removed, 0 AS renamed, NULL AS note FROM named_head WHERE (caller_file, caller_name, callee_name) NOT IN (SELECT caller_file, caller_name, callee_name FROM named_base)
UNION ALL SELECT 'call', 0, 'call', caller_file, caller_name, callee_name, 0, 1, 0, NULL FROM named_base WHERE (caller_file, caller_name, callee_name) NOT IN (SELECT caller_file, caller_name, callee_name FROM named_head)
UNION ALL SELECT 'state', 1, 'state|' || file || '|' || name, file, name, NULL, na, nr, 0, NULL FROM ({_SETS.format(name='name', b='var_base', h='var_head')}) WHERE na + nr > 0
UNION ALL SELECT 'api', 2, 'api|' || file || '|' || name, file, name, NULL, CAST(after_signature IS NOT NULL AS INTEGER), CAST(before_signature IS NOT NULL AS INTEGER), 0, NULL FROM api
UNION ALL SELECT 'lock', 3, 'lock|' || file || '|' || primitive, file, primitive, NULL, a, 1 - a, 0, NULL FROM ((SELECT *, 0 AS a FROM (SELECT * FROM hits_base EXCEPT SELECT * FROM hits_head)) UNION ALL (SELECT *, 1 FROM (SELECT * FROM hits_head EXCEPT SELECT * FROM hits_base)))
UNION ALL SELECT 'data', 4, 'data|' || file || '|' || type_name, file, type_name, NULL, CASE WHEN na = 1 AND nr = 1 THEN 0 ELSE na END, CASE WHEN na = 1 AND nr = 1 THEN 0 ELSE nr END, CASE WHEN na = 1 AND nr = 1 THEN 1 ELSE 0 END, NULL FROM ({_SETS.format(name='type_name', b='shape_base', h='shape_head')}) WHERE na + nr > 0
UNION ALL SELECT 'docs', 5, 'docs|' || file || '|' || type_name, file, type_name, NULL, 0, 0, 0, CASE WHEN nb <> nh THEN 'param-count' ELSE 'param-names' END FROM (SELECT file, type_name, count(*) AS nb, string_agg(item, ',' ORDER BY item) AS xb FROM shape_base GROUP BY ALL) b JOIN (SELECT file, type_name, count(*) AS nh, string_agg(item, ',' ORDER BY item) AS xh FROM shape_head GROUP BY ALL) h USING (file, type_name) WHERE xb <> xh
UNION ALL SELECT 'deletion', 6, 'deletion|' || file || '|' || name, file, name, NULL, 0, 1, 0, CASE WHEN bool_or(signature LIKE 'export %' OR signature LIKE 'pub %') THEN 'exported ' ELSE '' END FROM nodes_base WHERE name NOT IN (SELECT name FROM nodes_head) GROUP BY file, name)"""
_HUNK_VIEWS = "named_base named_head var_base var_head api hits_base hits_head shape_base shape_head"
_REFS = "refs AS (SELECT DISTINCT hunk_id, CASE WHEN kind = 'lock' THEN string_split(name, '.')[-1] ELSE name END AS entity FROM hunks UNION SELECT hunk_id, callee FROM hunks WHERE callee IS NOT NULL)"
_MEMBERS = "members AS (SELECT coalesce(split_part(min(entity) FILTER (contains(entity, '.')), '.', 1), 'top-level') AS flow, hunk_id FROM refs GROUP BY hunk_id)"


@query(_HUNK_VIEWS, "SELECT kind, CAST(kind_rank AS BIGINT) AS kind_rank, file, name FROM hunks", _HUNKS)
def q_hunks_union(t: Tables) -> DataFrame:
    return _all_hunks(t).select("kind", big("kind_rank", "kind_rank"), "file", "name")


@query(_HUNK_VIEWS, "SELECT kind, count(*) AS hunks, count(DISTINCT file) AS files FROM hunks GROUP BY kind", _HUNKS)
def q_hunk_counts(t: Tables) -> DataFrame:
    return _all_hunks(t).groupBy("kind").agg(F.count("*").alias("hunks"), F.countDistinct("file").alias("files"))


@query(_HUNK_VIEWS, """SELECT hunk_id, kind, CASE WHEN kind = 'docs' THEN 'both' WHEN a > 0 AND r = 0 THEN 'added' WHEN a = 0 AND r > 0 THEN 'removed' ELSE 'both' END AS side,
CASE kind WHEN 'call' THEN 'call edges: +' || a || ' / -' || r WHEN 'state' THEN 'state `' || name || '`: +' || a || ' / -' || r || ' variant(s)' WHEN 'api' THEN 'api `' || name || '` signature changed' WHEN 'lock' THEN 'lock `' || name || '` in ' || file
WHEN 'data' THEN 'data `' || name || '` in ' || file || ': +' || a || '/-' || r || ' fields, ' || n || ' renamed' WHEN 'docs' THEN 'docs drift (' || note || ') on `' || name || '` in ' || file ELSE 'deletion: ' || note || '`' || name || '` in ' || file END AS summary
FROM (SELECT hunk_id, kind, sum(added) AS a, sum(removed) AS r, sum(renamed) AS n, any_value(file) AS file, any_value(name) AS name, any_value(note) AS note FROM hunks GROUP BY ALL)""", _HUNKS)
def q_hunk_list(t: Tables) -> DataFrame:
    return hunks.summaries(_all_hunks(t))


@query("diag_base diag_head", """SELECT 'new' AS class, file, line, col, code FROM diag_head h WHERE (file, line, col, code) NOT IN (SELECT file, line, col, code FROM diag_base)
UNION ALL SELECT 'resolved', file, line, col, code FROM diag_base WHERE (file, line, col, code) NOT IN (SELECT file, line, col, code FROM diag_head)
UNION ALL SELECT 'persistent', file, line, col, code FROM diag_head WHERE (file, line, col, code) IN (SELECT file, line, col, code FROM diag_base)""")
def q_diag_delta(t: Tables) -> DataFrame:
    return row_classes(t.diagnostics("base"), t.diagnostics("head"), ["file", "line", "col", "code"]).select("class", "file", "line", "col", "code")


def _coverage(t: Tables) -> DataFrame:
    d = keyed_diff(t.coverage("base"), t.coverage("head"), ["file"], ["permille"])
    return d.select("file", big("before_permille", "before"), big("after_permille", "after"), big(F.col("after_permille") - F.col("before_permille"), "delta"))


@query("cov_base cov_head", "SELECT file, b.permille AS before, h.permille AS after, h.permille - b.permille AS delta FROM cov_base b FULL JOIN cov_head h USING (file)")
def q_coverage_delta(t: Tables) -> DataFrame:
    return _coverage(t)


@query("cov_base cov_head", "SELECT file, h.permille - b.permille AS delta, CASE WHEN h.permille - b.permille <= -100 THEN 'high' WHEN h.permille - b.permille <= -20 THEN 'medium' ELSE 'low' END AS strength FROM cov_base b JOIN cov_head h USING (file) WHERE h.permille < b.permille")
def q_coverage_claims(t: Tables) -> DataFrame:
    return evidence.coverage_claims(_coverage(t)).select("file", "delta", "strength")


_PAGES_B = "SELECT url AS path, sha256(html) AS h FROM pages WHERE page_id % 3 <> 0"
_PAGES_H = "SELECT url AS path, sha256(html || CASE WHEN page_id % 7 = 0 THEN ' ' ELSE '' END) AS h FROM pages WHERE page_id % 3 <> 1"


@query("", f"SELECT path, CASE WHEN b.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN b.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT path, max(h) AS h FROM ({_PAGES_B}) GROUP BY path) b FULL JOIN (SELECT path, max(h) AS h FROM ({_PAGES_H}) GROUP BY path) n USING (path)")
def q_changed_files(t: Tables) -> DataFrame:
    p = F.col("page_id")
    b = t.pages.where(p % 3 != 0).groupBy(F.col("url").alias("path")).agg(F.max(F.sha2("html", 256)).alias("h"))
    n = t.pages.where(p % 3 != 1).groupBy(F.col("url").alias("path")).agg(F.max(F.sha2(F.concat("html", F.when(p % 7 == 0, " ").otherwise("")), 256)).alias("h"))
    return keyed_diff(b, n, ["path"], ["h"]).select("path", "status")


_STATUS = "SELECT name, CASE WHEN b.s IS NULL THEN 'added' WHEN h.s IS NULL THEN 'removed' WHEN b.s = h.s THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT name, arg_max(signature, node_id) AS s FROM nodes_base GROUP BY name) b FULL JOIN (SELECT name, arg_max(signature, node_id) AS s FROM nodes_head GROUP BY name) h USING (name)"


def _status(t: Tables) -> DataFrame:
    b, h = (t.nodes(s).groupBy("name").agg(F.max_by("signature", "node_id").alias("signature")) for s in ("base", "head"))
    return keyed_diff(b, h, ["name"], ["signature"]).select("name", "status")


@query("nodes_base nodes_head", _STATUS)
def q_entity_status(t: Tables) -> DataFrame:
    return _status(t)


@query("nodes_base nodes_head", f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY status")
def q_status_counts(t: Tables) -> DataFrame:
    return _status(t).groupBy("status").agg(F.count("*").alias("n"))


@query("nodes_base nodes_head", """SELECT file, rn AS pair, r.name AS removed, a.name AS added FROM (SELECT file, name, row_number() OVER (PARTITION BY file ORDER BY node_id) AS rn FROM nodes_base WHERE name NOT IN (SELECT name FROM nodes_head)) r
JOIN (SELECT file, name, row_number() OVER (PARTITION BY file ORDER BY node_id) AS rn FROM nodes_head WHERE name NOT IN (SELECT name FROM nodes_base)) a USING (file, rn)""")
def q_replacements(t: Tables) -> DataFrame:
    b, h = t.nodes("base"), t.nodes("head")
    gone = b.join(h.select("name").distinct(), "name", "left_anti").select("file", F.col("name").alias("removed"), F.col("node_id").alias("bn"))
    new = h.join(b.select("name").distinct(), "name", "left_anti").select("file", F.col("name").alias("added"), F.col("node_id").alias("hn"))
    return paired(gone, new, ["file"], [F.col("bn")], [F.col("hn")]).where("removed is not null and added is not null").select("file", big("pair", "pair"), "removed", "added")


@query("named_base named_head", """SELECT caller, rn AS pair, r.callee AS removed, a.callee AS added FROM
(SELECT caller_name AS caller, callee_name AS callee, row_number() OVER (PARTITION BY caller_name ORDER BY src, dst) AS rn FROM named_base WHERE (caller_file, caller_name, callee_name) NOT IN (SELECT caller_file, caller_name, callee_name FROM named_head)) r
FULL JOIN (SELECT caller_name AS caller, callee_name AS callee, row_number() OVER (PARTITION BY caller_name ORDER BY src, dst) AS rn FROM named_head WHERE (caller_file, caller_name, callee_name) NOT IN (SELECT caller_file, caller_name, callee_name FROM named_base)) a USING (caller, rn)""")
def q_edge_pairs(t: Tables) -> DataFrame:
    d = hunks.call_delta(*(hunks.named_edges(t.edges(s), t.nodes(s)) for s in ("base", "head")))
    side = lambda change, alias: d.where(F.col("change") == change).select(F.col("caller_name").alias("caller"), F.col("callee_name").alias(alias), F.col("src").alias(f"{alias}_s"), F.col("dst").alias(f"{alias}_d"))
    p = paired(side("removed", "removed"), side("added", "added"), ["caller"], [F.col("removed_s"), F.col("removed_d")], [F.col("added_s"), F.col("added_d")])
    return p.select("caller", big("pair", "pair"), "removed", "added")


_LOCAL = "SELECT DISTINCT x.flow, caller_name AS a, callee_name AS b FROM named_{side} JOIN flows_a x ON x.entity = caller_name JOIN flows_a y ON y.entity = callee_name AND y.flow = x.flow WHERE caller_name <> callee_name"
_BASE_LOCAL, _HEAD_LOCAL = _LOCAL.format(side="base"), _LOCAL.format(side="head")


@query("named_base named_head flows_a", f"SELECT 'added' AS change, flow, a, b FROM ({_HEAD_LOCAL} EXCEPT {_BASE_LOCAL}) UNION ALL SELECT 'removed', flow, a, b FROM ({_BASE_LOCAL} EXCEPT {_HEAD_LOCAL})")
def q_flow_pairs(t: Tables) -> DataFrame:
    e = t.flows_a().select("flow", "entity").distinct()

    def local(side: str) -> DataFrame:
        named = hunks.named_edges(t.edges(side), t.nodes(side)).select("caller_name", "callee_name").where("caller_name <> callee_name").distinct()
        return named.join(e.select("flow", F.col("entity").alias("caller_name")), "caller_name").join(e.select("flow", F.col("entity").alias("callee_name")), ["flow", "callee_name"])

    d = keyed_diff(local("base"), local("head"), ["flow", "caller_name", "callee_name"], []).where("status <> 'unchanged'")
    return d.select(F.col("status").alias("change"), "flow", F.col("caller_name").alias("a"), F.col("callee_name").alias("b"))


@query(_HUNK_VIEWS, "SELECT file, CAST(n AS BIGINT) AS hunks, CAST(coalesce(f, 0) AS BIGINT) AS flows FROM (SELECT file, count(DISTINCT hunk_id) AS n FROM hunks GROUP BY file) LEFT JOIN (SELECT file, count(DISTINCT flow) AS f FROM hunks JOIN members USING (hunk_id) GROUP BY file) USING (file)", f"{_HUNKS}, {_REFS}, {_MEMBERS}")
def q_file_rollup(t: Tables) -> DataFrame:
    h = written(_all_hunks(t), "hunks")
    return resolve.per_file(resolve.hunk_files(h), flows.membership(resolve.hunk_entities(h)))


@query(_HUNK_VIEWS, "SELECT flow, count(*) AS hunks, count(DISTINCT kind) AS kinds FROM members JOIN (SELECT DISTINCT hunk_id, kind FROM hunks) USING (hunk_id) GROUP BY flow", f"{_HUNKS}, {_REFS}, {_MEMBERS}")
def q_flows_of_all_kinds(t: Tables) -> DataFrame:
    h = written(_all_hunks(t), "hunks")
    kinds = h.select("hunk_id", "kind").distinct()
    return flows.membership(resolve.hunk_entities(h)).join(kinds, "hunk_id").groupBy("flow").agg(F.count("*").alias("hunks"), F.countDistinct("kind").alias("kinds"))


@query("nodes_base", "SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(b || ':' || x, chr(10) ORDER BY b || ':' || x)) AS sha FROM (SELECT substr(h, 1, 2) AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS x FROM (SELECT sha256(file || '|' || name || '|' || signature) AS h FROM nodes_base) GROUP BY 1)")
def q_snapshot_sha(t: Tables) -> DataFrame:
    return state.snapshot_hash(t.nodes("base"), F.concat_ws("|", "file", "name", "signature"))


# ---- references between deltas, entities and files ------------------------------------------------------------


@query(_HUNK_VIEWS, "SELECT hunk_id, entity FROM refs", f"{_HUNKS}, {_REFS}")
def q_hunk_entities(t: Tables) -> DataFrame:
    return resolve.hunk_entities(_all_hunks(t))


@query(_HUNK_VIEWS, "SELECT hunk_id, CASE WHEN kind IN ('lock', 'data', 'docs') THEN file || ':' || name ELSE name END AS entity FROM hunks UNION ALL SELECT hunk_id, callee FROM hunks WHERE callee IS NOT NULL", _HUNKS)
def q_session_entities(t: Tables) -> DataFrame:
    return resolve.session_entities(_all_hunks(t))


@query(_HUNK_VIEWS, "SELECT DISTINCT hunk_id, file FROM hunks", _HUNKS)
def q_hunk_files(t: Tables) -> DataFrame:
    return resolve.hunk_files(_all_hunks(t))


@query("flows_a nodes_head", "SELECT DISTINCT flow FROM flows_a x JOIN nodes_head n ON n.name = x.entity WHERE n.file IN (SELECT file FROM nodes_head WHERE node_id % 13 = 0)")
def q_flow_tests(t: Tables) -> DataFrame:
    failing = t.nodes("head").where("node_id % 13 = 0").select("file").distinct()
    return resolve.flows_of_failures(t.flows_a(), t.nodes("head"), failing)


_COV_NODES = "cn AS (SELECT file, CAST(sum(node_id) FILTER (node_id % 2 = 0) % 1000 AS BIGINT) AS before, CAST(sum(node_id) FILTER (node_id % 2 = 1) % 1000 AS BIGINT) AS after FROM nodes_head GROUP BY file)"


@query("flows_a nodes_head", "SELECT DISTINCT x.flow, cn.file, after - before AS delta, CASE WHEN after - before <= -100 THEN 'high' WHEN after - before <= -20 THEN 'medium' ELSE 'low' END AS strength FROM cn JOIN nodes_head n ON n.file = cn.file JOIN flows_a x ON x.entity = n.name WHERE after < before", _COV_NODES)
def q_flow_coverage(t: Tables) -> DataFrame:
    n = t.nodes("head")
    share = lambda r: (F.sum(F.when(F.col("node_id") % 2 == r, F.col("node_id"))) % 1000).cast("long")
    drops = evidence.coverage_claims(n.groupBy("file").agg(share(0).alias("before"), share(1).alias("after")).withColumn("delta", F.col("after") - F.col("before")))
    return resolve.flows_touching(t.flows_a(), n, drops).join(drops.select("file", "delta", "strength"), "file").select("flow", "file", "delta", "strength")


@query("nodes_head", "SELECT file, name, CAST(line AS BIGINT) AS line FROM (SELECT file, name, unnest(range(node_id % 50, node_id % 50 + length(signature) % 5 + 1)) AS line FROM nodes_head WHERE kind = 'type')")
def q_touched_lines(t: Tables) -> DataFrame:
    n = t.nodes("head").where("kind = 'type'").select("file", "name", (F.col("node_id") % 50).alias("first"), (F.col("node_id") % 50 + F.length("signature") % 5).alias("last"))
    return resolve.touched_lines(n).select("file", "name", big("line", "line"))


@query("flows_a diag_head", "SELECT flow, count(*) AS hits FROM (SELECT DISTINCT flow, file FROM (SELECT flow, 'f' || (length(entity) * 7 + length(file)) AS file FROM flows_a)) x JOIN diag_head USING (file) GROUP BY flow")
def q_flow_diagnostics(t: Tables) -> DataFrame:
    return resolve.flow_hits(_flow_files(t), t.diagnostics("head"), "file")


def _flow_files(t: Tables) -> DataFrame:
    return t.flows_a().select("flow", F.concat(F.lit("f"), (F.length("entity") * 7 + F.length("file")).cast("string")).alias("file")).distinct()


_DIAG = "SELECT 'new' AS class, * FROM diag_head WHERE (file, line, col, code) NOT IN (SELECT file, line, col, code FROM diag_base) UNION ALL SELECT 'resolved', * FROM diag_base WHERE (file, line, col, code) NOT IN (SELECT file, line, col, code FROM diag_head)"


@query("flows_a diag_base diag_head", f"""SELECT flow, class, count(*) AS n, array_to_string(list_sort(list(DISTINCT d.file || ':' || line || ':' || code))[1:3], ',') AS preview, CASE class WHEN 'new' THEN 'high' ELSE 'medium' END AS strength
FROM (SELECT DISTINCT flow, 'f' || (length(entity) * 7 + length(file)) AS file FROM flows_a) f JOIN ({_DIAG}) d USING (file) GROUP BY flow, class""")
def q_compile_claims(t: Tables) -> DataFrame:
    d = row_classes(t.diagnostics("base"), t.diagnostics("head"), ["file", "line", "col", "code"])
    return evidence.compile_claims(_flow_files(t), d)


@query("", """SELECT kind, base_exit, head_exit, CASE WHEN base_exit = 0 THEN 'high' ELSE 'medium' END AS strength FROM (SELECT user_id AS kind, CAST(count(*) FILTER (event_id % 3 = 0 AND event_type = 'error') > 2 AS BIGINT) AS base_exit, CAST(count(*) FILTER (event_id % 3 = 1 AND event_type = 'error') > 2 AS BIGINT) AS head_exit FROM events GROUP BY user_id) WHERE base_exit <> head_exit""")
def q_test_run_claims(t: Tables) -> DataFrame:
    exit_ = lambda r: (F.count_if((F.col("event_id") % 3 == r) & (F.col("event_type") == "error")) > 2).cast("long")
    return evidence.run_claims(t.events.groupBy(F.col("user_id").alias("kind")).agg(exit_(0).alias("base_exit"), exit_(1).alias("head_exit")))


@query("flows_a nodes_base nodes_head", """SELECT claim_id, arg_min(e.entity, (pos, e.entity)) AS entity, CAST(arg_min(rank, (pos, e.entity)) AS BIGINT) AS rank, arg_min(side, (pos, e.entity)) AS side, arg_min(file, (pos, e.entity)) AS file, arg_min(node_id, (pos, e.entity)) AS node_id
FROM (SELECT flow AS claim_id, entity, row_number() OVER (PARTITION BY flow ORDER BY entity) AS pos FROM (SELECT DISTINCT flow, entity FROM flows_a)) e
JOIN (SELECT entity, min(rank) AS rank, arg_min(side, (rank, node_id)) AS side, arg_min(file, (rank, node_id)) AS file, arg_min(node_id, (rank, node_id)) AS node_id FROM (
 SELECT name AS entity, 'head' AS side, node_id, file, 0 AS rank FROM nodes_head UNION ALL SELECT name, 'base', node_id, file, 2 FROM nodes_base
 UNION ALL SELECT string_split(name, '.')[-1], 'head', node_id, file, 1 FROM nodes_head WHERE contains(name, '.') UNION ALL SELECT string_split(name, '.')[-1], 'base', node_id, file, 3 FROM nodes_base WHERE contains(name, '.')) GROUP BY entity) n ON n.entity = e.entity
WHERE pos <= 6 GROUP BY claim_id""")
def q_claim_anchor(t: Tables) -> DataFrame:
    claims = t.flows_a().groupBy(F.col("flow").alias("claim_id")).agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    nodes = t.nodes("head").withColumn("side", F.lit("head")).unionByName(t.nodes("base").withColumn("side", F.lit("base")))
    return evidence.anchor(claims, nodes).select("claim_id", "entity", big("rank", "rank"), "side", "file", "node_id")


_PROOFS = "p AS (SELECT analysis_id, CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY flow_id) - 1 AS BIGINT) AS position, CASE WHEN flow_id % 3 = 0 THEN -1 ELSE CAST(2 * row_number() OVER (PARTITION BY analysis_id ORDER BY flow_id) AS BIGINT) END AS claim_index, proof FROM verdicts WHERE flow_id % 4 <> 0)"


@query("verdicts", "SELECT c.analysis_id, c.claim_index, c.flow_id, coalesce(o.proof, q.proof) AS proof, o.proof IS NOT NULL AS by_index FROM (SELECT analysis_id, flow_id, CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY flow_id) - 1 AS BIGINT) AS claim_index FROM verdicts) c LEFT JOIN (SELECT analysis_id, claim_index, arg_min(proof, position) AS proof FROM p GROUP BY ALL) o USING (analysis_id, claim_index) LEFT JOIN p q ON q.analysis_id = c.analysis_id AND q.position = c.claim_index", _PROOFS)
def q_claim_proof(t: Tables) -> DataFrame:
    index = (F.row_number().over(W.partitionBy("analysis_id").orderBy("flow_id")) - 1).cast("long")
    claims = t.verdicts().select("analysis_id", "flow_id", index.alias("claim_index"))
    named = F.when(F.col("flow_id") % 3 == 0, -1).otherwise(2 * (index + 1)).cast("long")
    proofs = t.verdicts().where("flow_id % 4 <> 0").select("analysis_id", index.alias("position"), named.alias("claim_index"), "proof")
    return resolve.claim_proof(claims, proofs)


@query("lines", """SELECT n.note_id, n.file, n.at, string_agg(CASE WHEN l.line = n.at THEN '> ' ELSE '  ' END || l.line || ' ' || l.content, chr(10) ORDER BY l.line) AS context, count(l.line) = 0 AS missing FROM (SELECT doc_id AS note_id, 'd' || doc_id AS file, CAST(doc_id % 9 + 1 AS BIGINT) AS at FROM labels) n LEFT JOIN lines l ON l.file = n.file AND l.line BETWEEN n.at - 5 AND n.at + 5 GROUP BY ALL""")
def q_note_export(t: Tables) -> DataFrame:
    notes = t.labels.select(F.col("doc_id").alias("note_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), (F.col("doc_id") % 9 + 1).alias("at"))
    return review.note_context(notes, t.lines())


@query("flows_a", "SELECT entity, count(*) AS flows, CAST(round(sum(net / CAST(n AS DOUBLE)), 6) AS DOUBLE) AS cost FROM (SELECT DISTINCT flow, entity FROM flows_a) f JOIN (SELECT flow, count(DISTINCT entity) AS n, length(flow) AS net FROM flows_a GROUP BY flow) USING (flow) GROUP BY entity")
def q_entity_detail(t: Tables) -> DataFrame:
    e = t.flows_a().select("flow", "entity").distinct()
    return review.entity_detail(e, e.select("flow").distinct().withColumn("net", F.length("flow")))


@query("flows_a", "SELECT DISTINCT a.flow, a.entity FROM flows_a a JOIN (SELECT flow, 'see' || entity || 's' AS text FROM flows_a WHERE length(signature) % 2 = 0 UNION ALL SELECT flow, file FROM flows_a) e ON e.flow = a.flow AND contains(e.text, a.entity)")
def q_deliverers(t: Tables) -> DataFrame:
    f = t.flows_a()
    detail = F.when(F.length("signature") % 2 == 0, F.concat(F.lit("see"), F.col("entity"), F.lit("s")))
    return review.deliverers(f, f.select("flow", detail.alias("detail"), F.col("file").alias("path")))


# ---- graph ----------------------------------------------------------------------------------------------------


def _first_parts(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("node")).select("node")


_SMALL = "small AS (SELECT p_brand AS b, min(p_partkey) AS node FROM part GROUP BY p_brand)"  # the first part of each brand: seeds that grow with the table


@query("edges_head", "SELECT CAST(node AS BIGINT) AS node, CAST(min(hop) AS BIGINT) AS hop FROM r GROUP BY node", _SMALL + ", u AS (SELECT src, dst FROM edges_head UNION SELECT dst, src FROM edges_head), r(node, hop) AS (SELECT node, 0 FROM small UNION SELECT u.dst, r.hop + 1 FROM r JOIN u ON u.src = r.node WHERE r.hop < 2)")
def q_neighbors(t: Tables) -> DataFrame:
    return graph.neighbours(t.edges("head"), _first_parts(t), 2).select("node", big("hop", "hop"))


@query("edges_head", "SELECT src, dst FROM edges_head WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)", _SMALL + ", r(node) AS (SELECT node FROM small UNION SELECT dst FROM edges_head WHERE src IN (SELECT node FROM small) UNION SELECT src FROM edges_head WHERE dst IN (SELECT node FROM small))")
def q_induced_subgraph(t: Tables) -> DataFrame:
    return graph.induced(t.edges("head"), graph.neighbours(t.edges("head"), _first_parts(t), 1))


_SEEDS = "seeds AS (SELECT DISTINCT p_brand AS flow, p_partkey AS node FROM part)"
_REACH = """u AS (SELECT src, dst FROM edges_head UNION SELECT dst, src FROM edges_head), h1 AS (SELECT DISTINCT s.flow, u.dst AS node FROM seeds s JOIN u ON u.src = s.node EXCEPT SELECT * FROM seeds),
h2 AS (SELECT DISTINCT h.flow, u.dst AS node FROM h1 h JOIN u ON u.src = h.node EXCEPT SELECT * FROM seeds EXCEPT SELECT * FROM h1),
x AS (SELECT flow, node, row_number() OVER (PARTITION BY flow ORDER BY hop, node) AS r FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2)),
reach AS (SELECT flow, node, TRUE AS seed FROM seeds UNION ALL SELECT flow, node, FALSE FROM x WHERE r <= 20),
prop AS (SELECT a.flow, e.src, e.dst, a.seed AS src_seed, b.seed AS dst_seed FROM edges_head e JOIN reach a ON a.node = e.src JOIN reach b ON b.node = e.dst AND b.flow = a.flow WHERE NOT (a.seed AND b.seed))"""


def _propagation(t: Tables) -> DataFrame:
    seeds = t.part.select(F.col("p_brand").alias("flow"), F.col("p_partkey").alias("node"))
    return graph.propagation(t.edges("head"), seeds)


@query("edges_head", "SELECT * FROM prop", f"{_SEEDS}, {_REACH}")
def q_propagation(t: Tables) -> DataFrame:
    return _propagation(t)


@query("edges_head", "SELECT flow, CASE WHEN src_seed THEN 'out' WHEN dst_seed THEN 'in' ELSE 'through' END AS way, count(*) AS n FROM prop GROUP BY ALL", f"{_SEEDS}, {_REACH}")
def q_propagation_split(t: Tables) -> DataFrame:
    return graph.split_in_out(_propagation(t)).groupBy("flow", "way").agg(F.count("*").alias("n"))


_CHAIN = """fe AS (SELECT p_type AS flow, src, dst FROM edges_head JOIN part ON p_partkey = src), en AS (SELECT flow, src AS node FROM fe UNION ALL SELECT flow, dst FROM fe), dg AS (SELECT flow, node, count(*) AS k FROM en GROUP BY ALL)"""


@query("edges_head", "SELECT fe.flow, count(*) AS edges, bool_and(greatest(a.k, b.k) >= 2) AS connected, CASE WHEN count(*) = 1 THEN 'medium' WHEN bool_and(greatest(a.k, b.k) >= 2) THEN 'high' ELSE 'low' END AS strength FROM fe JOIN dg a ON a.flow = fe.flow AND a.node = src JOIN dg b ON b.flow = fe.flow AND b.node = dst GROUP BY fe.flow", _CHAIN)
def q_call_chain(t: Tables) -> DataFrame:
    e = t.edges("head").join(t.part.select(F.col("p_partkey").alias("src"), F.col("p_type").alias("flow")), "src")
    return evidence.call_chain(graph.chain_connected(e))


@query("", "SELECT node, CAST(max(h) AS BIGINT) AS level FROM r GROUP BY node", """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'n' || c_nationkey, 'o' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(node, h) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.h + 1 FROM r JOIN e ON e.src = r.node)""")
def q_layout_levels(t: Tables) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = t.nation.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    edges = edges.union(t.customer.select(key("n", "c_nationkey"), key("c", "c_custkey"))).union(t.orders.select(key("c", "o_custkey"), key("o", "o_orderkey")))
    edges = edges.union(t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(key("n", "c_nationkey"), key("o", "o_orderkey")))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return graph.levels(edges, nodes).select("node", big("level", "level"))


def call_and_api_entities(t: Tables) -> DataFrame:
    """(hunk_id, entity) of the call and signature deltas."""
    calls = hunks.call_delta(*(hunks.named_edges(t.edges(s), t.nodes(s)) for s in ("base", "head")))
    by_call = calls.select(F.concat_ws("|", "change", "caller_file", "caller_name", "callee_name").alias("hunk_id"), F.explode(F.array("caller_name", "callee_name")).alias("entity"))
    return by_call.union(t.api_hunks().select("hunk_id", "entity"))


# ---- flows ----------------------------------------------------------------------------------------------------

_FLOWS = """SELECT flow, count(*) AS n_hunks, string_agg(hunk_id, ',' ORDER BY hunk_id) AS hunks FROM (SELECT DISTINCT flow, hunk_id FROM flows_a) GROUP BY flow"""


def _structural(t: Tables) -> DataFrame:
    return flows.structural(t.api_hunks().select("hunk_id", "entity"))


@query("flows_a", f"SELECT f.flow, CAST(n_hunks AS BIGINT) AS n_hunks, hunks, entities, CAST(row_number() OVER (ORDER BY f.flow) - 1 AS BIGINT) AS position FROM ({_FLOWS}) f JOIN (SELECT flow, string_agg(entity, ',' ORDER BY entity) AS entities FROM (SELECT DISTINCT flow, entity FROM flows_a) GROUP BY flow) USING (flow)")
def q_flows(t: Tables) -> DataFrame:
    return _structural(t).select("flow", "n_hunks", joined("hunks"), joined("entities"), big("position", "position"))


_RANK = "SELECT flow, count(DISTINCT hunk_id) * 2 + count(DISTINCT entity) AS weight FROM flows_a GROUP BY flow"


@query("flows_a", f"SELECT flow, CAST(weight AS BIGINT) AS weight, CAST(row_number() OVER (ORDER BY weight DESC, flow) AS BIGINT) AS rank FROM ({_RANK})")
def q_flow_rank(t: Tables) -> DataFrame:
    w = _structural(t).select("flow", flows.weight(F.col("n_hunks"), F.size("entities")).alias("weight"))
    return w.select("flow", big("weight", "weight"), big(F.row_number().over(W.orderBy(F.desc("weight"), "flow")), "rank"))  # a row for each flow


@query("flows_a", "SELECT flow, CAST(row_number() OVER (ORDER BY flow <> 'top-level', flow) AS BIGINT) AS place FROM (SELECT DISTINCT flow FROM flows_a)")
def q_nav_order(t: Tables) -> DataFrame:
    order = W.orderBy(F.col("flow") != flows.TOP_LEVEL, "flow")
    return _structural(t).select("flow", big(F.row_number().over(order), "place"))


@query("flows_a", "SELECT flow, CAST(n AS BIGINT) AS n_files, preview, CASE WHEN n = 1 THEN 'single-file' ELSE 'cross-file' END AS claim, CASE WHEN n = 1 THEN 'high' WHEN n <= 3 THEN 'medium' ELSE 'low' END AS strength FROM (SELECT flow, count(DISTINCT file) AS n, array_to_string(list_sort(list(DISTINCT file))[1:3], ',') AS preview FROM flows_a GROUP BY flow)")
def q_file_scope(t: Tables) -> DataFrame:
    return evidence.file_scope(t.flows_a()).select("flow", "n_files", "preview", "claim", "strength")


@query("flows_a", """SELECT flow, CAST(n AS BIGINT) AS n, CAST(coalesce(shared, 0) AS BIGINT) AS shared, coalesce(preview, '') AS preview, CASE WHEN coalesce(shared, 0) >= 2 THEN 'high' WHEN n >= 3 THEN 'low' END AS strength FROM (SELECT flow, count(*) AS n FROM flows_a GROUP BY flow) LEFT JOIN
(SELECT flow, count(*) AS shared, array_to_string(list_sort(list(tok))[1:3], ',') AS preview FROM (SELECT flow, tok, count(*) AS k FROM (SELECT DISTINCT flow, hunk_id, unnest(list_filter(string_split_regex(signature, '[^A-Za-z0-9]+'), lambda x: length(x) > 2)) AS tok FROM flows_a) GROUP BY ALL) JOIN (SELECT flow, count(*) AS n FROM flows_a GROUP BY flow) USING (flow) WHERE k = n GROUP BY flow) USING (flow) WHERE n >= 2 AND (coalesce(shared, 0) >= 2 OR n >= 3)""")
def q_sig_consistency(t: Tables) -> DataFrame:
    return evidence.signature_consistency(t.flows_a().select("flow", "hunk_id", "signature"))


_TOKENS = r"list_distinct(list_filter(string_split_regex(lower(entity), '[.: ]'), lambda x: length(x) >= 3))"


@query("flows_a", f"""SELECT flow, CAST(coalesce(tests, 0) AS BIGINT) AS tests, CAST(coalesce(examples, 0) AS BIGINT) AS examples, CASE WHEN coalesce(tests, 0) > 0 OR coalesce(examples, 0) > 0 THEN 'high' WHEN (SELECT count(*) FROM fl WHERE is_test) = 0 THEN 'low' END AS strength FROM (SELECT DISTINCT flow FROM flows_a) LEFT JOIN
(SELECT flow, count(*) FILTER (is_test) AS tests, count(*) FILTER (is_example) AS examples FROM (SELECT DISTINCT flow, unnest({_TOKENS}) AS token FROM flows_a) JOIN (SELECT is_test, is_example, unnest(list_distinct(list_filter(string_split_regex(lower(string_split(file, '/')[-1]), '[^a-z0-9]+'), lambda x: length(x) >= 3))) AS token FROM fl WHERE is_test OR is_example) USING (token) GROUP BY flow) USING (flow)""",
       "fl AS (SELECT CASE p_size % 3 WHEN 0 THEN 'tests/' WHEN 1 THEN 'examples/' ELSE 'src/' END || replace(p_name, ' ', '-') || '.ts' AS file, p_size % 3 = 0 AS is_test, p_size % 3 = 1 AS is_example FROM part)")
def q_test_coverage(t: Tables) -> DataFrame:
    folder = F.element_at(F.array(F.lit("tests/"), F.lit("examples/"), F.lit("src/")), (F.col("p_size") % 3 + 1).cast("int"))
    files = t.part.select(F.concat(folder, F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".ts")).alias("file"))
    files = files.select("file", tx.is_test_path(F.col("file")).alias("is_test"), tx.is_example_path(F.col("file")).alias("is_example"))
    return evidence.test_coverage(t.flows_a().select("flow", "entity"), files)


@query("flows_a", "SELECT h.hunk_id FROM (SELECT DISTINCT hunk_id FROM flows_a) h WHERE hunk_id NOT IN (SELECT hunk_id FROM flows_a WHERE length(entity) % 3 <> 0)")
def q_uncovered_hunks(t: Tables) -> DataFrame:
    a = t.flows_a()
    return flows.uncovered(a, a.where("length(entity) % 3 <> 0").select("flow", "hunk_id"))


_BOTH = "fh AS (SELECT DISTINCT flow, hunk_id FROM flows_a UNION SELECT 'odd', hunk_id FROM flows_a WHERE length(entity) % 2 = 1)"


@query("flows_a", "SELECT f.flow, CAST(count(o.hunk_id) AS BIGINT) AS orphans FROM (SELECT DISTINCT flow FROM fh) f LEFT JOIN (SELECT any_value(flow) AS flow, hunk_id FROM fh GROUP BY hunk_id HAVING count(*) = 1) o USING (flow) GROUP BY f.flow", _BOTH)
def q_orphan_check(t: Tables) -> DataFrame:
    a = t.flows_a().select("flow", "hunk_id", "entity")
    both = a.select("flow", "hunk_id").union(a.where("length(entity) % 2 = 1").select(F.lit("odd"), "hunk_id"))
    return flows.orphaned_by_removal(both)


@query("flows_a flows_b nodes_head", """SELECT *, rank = (SELECT min(rank) FROM ru WHERE n > 0) AS first FROM ru""", """ru AS (SELECT 1 AS rank, 'coverage' AS rule, (SELECT count(*) FROM (SELECT DISTINCT hunk_id FROM flows_a WHERE length(hunk_id) % 5 <> 0 AND length(entity) % 3 = 0)) AS n UNION ALL SELECT 2, 'reserved-name', 1
UNION ALL SELECT 3, 'entity-not-found', (SELECT count(*) FROM (SELECT DISTINCT flow, entity FROM flows_a) WHERE entity NOT IN (SELECT name FROM nodes_head)) UNION ALL SELECT 4, 'hunk-not-found', (SELECT count(*) FROM (SELECT DISTINCT flow, hunk_id FROM flows_a) WHERE length(hunk_id) % 5 = 0) UNION ALL SELECT 5, 'call-budget', 5)""")
def q_finalize_violations(t: Tables) -> DataFrame:
    a = t.flows_a()
    names = a.select("flow").distinct().union(t.region.where("r_regionkey = 0").select(F.lit("Misc")))
    # a fifth of the hunks is unknown, a third of the others is in no flow
    got = flows.finalize_violation(a.where("length(hunk_id) % 5 <> 0"), a.where("length(entity) % 3 <> 0 or length(hunk_id) % 5 = 0").select("flow", "hunk_id"), a.select("flow", "entity").distinct(), names, t.nodes("head").select(F.col("name").alias("entity")), calls=205)
    return got.select("rank", "rule", "n", "first")


@query("flows_a", """SELECT flow, count(*) FILTER (c.hunk_id IS NULL) AS "foreign", count(*) FILTER (times > 1) AS doubled, count(*) FILTER (times IS NULL) AS missing FROM (SELECT DISTINCT flow, hunk_id FROM flows_a) c FULL JOIN (SELECT flow, hunk_id, count(*) AS times FROM pa GROUP BY ALL) p USING (flow, hunk_id) GROUP BY flow""", "pa AS (SELECT DISTINCT flow, 'a' AS part, hunk_id FROM flows_a WHERE length(hunk_id) % 5 <> 0 UNION ALL SELECT DISTINCT flow, 'b', hunk_id FROM flows_a WHERE length(hunk_id) % 7 = 0 UNION ALL SELECT DISTINCT flow, 'b', hunk_id || '!' FROM flows_a WHERE length(hunk_id) % 11 = 0)")
def q_partition_check(t: Tables) -> DataFrame:
    c = t.flows_a().select("flow", "hunk_id").distinct()
    n = F.length("hunk_id")
    parts = c.where(n % 5 != 0).select("flow", F.lit("a").alias("part"), "hunk_id").union(c.where(n % 7 == 0).select("flow", F.lit("b"), "hunk_id")).union(c.where(n % 11 == 0).select("flow", F.lit("b"), F.concat("hunk_id", F.lit("!"))))
    return flows.partition_errors(c, parts)


@query("flows_a", "SELECT new_name, CASE WHEN flow = new_name THEN 'structural' ELSE 'proposed' END AS source, count(*) AS hunks FROM (SELECT DISTINCT flow, CASE WHEN length(flow) % 2 = 0 THEN flow || '/' || (length(hunk_id) % 2) ELSE flow END AS new_name, hunk_id FROM flows_a) GROUP BY ALL")
def q_synth_assembly(t: Tables) -> DataFrame:
    c = t.flows_a().select("flow", "hunk_id").distinct()
    part = (F.length("hunk_id") % 2).cast("string")
    proposals = c.where(F.length("flow") % 2 == 0).select("flow", F.concat("flow", F.lit("/"), part).alias("new_name"), part.alias("part"), "hunk_id")
    return flows.assemble(c, proposals).groupBy("new_name", "source").agg(F.count("*").alias("hunks"))


@query("flows_a", "SELECT flow, count(*) AS hunks FROM (SELECT DISTINCT flow, hunk_id FROM flows_a WHERE length(hunk_id) % 4 <> 0 UNION SELECT 'extra', hunk_id FROM flows_a WHERE length(hunk_id) % 4 = 0) GROUP BY flow")
def q_flow_edit(t: Tables) -> DataFrame:
    c = t.flows_a().select("flow", "hunk_id").distinct()
    gone = c.where(F.length("hunk_id") % 4 == 0)
    # some of what goes is added, too: it goes all the same
    both = gone.where(F.length("hunk_id") % 8 == 0)
    return flows.edit(c, gone.select(F.lit("extra").alias("flow"), "hunk_id").union(both), gone).groupBy("flow").agg(F.count("*").alias("hunks"))


_JACCARD = "SELECT a.flow AS flow_a, b.flow AS flow_b, count(*) AS shared, any_value(na) - count(*) AS a_only, any_value(nb) - count(*) AS b_only, round(count(*) / CAST(any_value(na) + any_value(nb) - count(*) AS DOUBLE), 6) AS jaccard FROM (SELECT DISTINCT flow, hunk_id FROM flows_a) a JOIN (SELECT DISTINCT flow, hunk_id FROM flows_b) b USING (hunk_id) JOIN (SELECT flow, count(DISTINCT hunk_id) AS na FROM flows_a GROUP BY flow) x ON x.flow = a.flow JOIN (SELECT flow, count(DISTINCT hunk_id) AS nb FROM flows_b GROUP BY flow) y ON y.flow = b.flow GROUP BY a.flow, b.flow"


@query("flows_a flows_b", _JACCARD)
def q_jaccard(t: Tables) -> DataFrame:
    return flows.jaccard_pairs(t.flows_a(), t.flows_b())


_GREEDY = f"""j AS ({_JACCARD}), w AS (SELECT flow_a, row_number() OVER (ORDER BY n DESC, flow_a) AS i, c FROM (SELECT flow_a, any_value(shared + a_only) AS n, list(flow_b ORDER BY jaccard DESC, flow_b) AS c FROM j GROUP BY flow_a)),
g(i, taken, b) AS (SELECT 0, CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR) UNION ALL SELECT w.i, CASE WHEN x IS NULL THEN taken ELSE list_append(taken, x) END, x FROM (SELECT w.i, g.taken, list_filter(w.c, lambda y: NOT list_contains(g.taken, y))[1] AS x FROM g JOIN w ON w.i = g.i + 1) w),
paired AS (SELECT w.flow_a, g.b AS flow_b FROM g JOIN w USING (i) WHERE g.b IS NOT NULL)"""


@query("flows_a flows_b", "SELECT flow_a, flow_b, jaccard FROM paired JOIN j USING (flow_a, flow_b)", _GREEDY)
def q_greedy_pairs(t: Tables) -> DataFrame:
    return flows.greedy_pairs(flows.jaccard_pairs(t.flows_a(), t.flows_b()))


@query("flows_a flows_b", f"SELECT (SELECT count(DISTINCT a.hunk_id) FROM flows_a a JOIN flows_b b USING (hunk_id) JOIN ({_JACCARD}) j ON j.flow_a = a.flow AND j.flow_b = b.flow WHERE jaccard >= 0.05) AS agreed, (SELECT count(DISTINCT hunk_id) FROM flows_a) AS total, round((SELECT count(DISTINCT a.hunk_id) FROM flows_a a JOIN flows_b b USING (hunk_id) JOIN ({_JACCARD}) j ON j.flow_a = a.flow AND j.flow_b = b.flow WHERE jaccard >= 0.05) / CAST((SELECT count(DISTINCT hunk_id) FROM flows_a) AS DOUBLE), 6) AS agreement")
def q_hunk_agreement(t: Tables) -> DataFrame:
    a, b = t.flows_a(), t.flows_b()
    return flows.agreement(flows.jaccard_pairs(a, b), a, b, 0.05)


_CMP = "fa AS (SELECT split_part(name, '.', 1) AS flow, count(*) AS size FROM api WHERE status <> 'added' GROUP BY 1), fb AS (SELECT split_part(name, '.', 1) AS flow, count(*) AS size FROM api WHERE status = 'changed' AND length(name) % 5 <> 0 GROUP BY 1)"


def _two_analyses(t: Tables) -> tuple[DataFrame, DataFrame]:
    h = t.api_hunks().withColumn("flow", F.split_part("entity", F.lit("."), F.lit(1)))
    size = lambda df: df.groupBy("flow").agg(F.count("*").alias("size")).withColumn("position", F.lit(0))
    return size(h.where("status <> 'added'")), size(h.where("status = 'changed' and length(entity) % 5 <> 0"))


@query("api", "SELECT flow, fa.size AS before_size, fb.size AS after_size, CASE WHEN fa.size IS NULL THEN 'only-b' WHEN fb.size IS NULL THEN 'only-a' ELSE 'both' END AS presence FROM fa FULL JOIN fb USING (flow)", _CMP)
def q_compare_flows(t: Tables) -> DataFrame:
    return review.compare_flows(*_two_analyses(t), ["size"])


@query("api", "SELECT (SELECT CAST(sum(size) AS BIGINT) FROM fa) AS a, (SELECT CAST(sum(size) AS BIGINT) FROM fb) AS b, (SELECT CAST(sum(size) AS BIGINT) FROM fb) - (SELECT CAST(sum(size) AS BIGINT) FROM fa) AS delta", _CMP)
def q_compare_agg(t: Tables) -> DataFrame:
    a, b = (df.agg(F.sum("size").alias(n)) for df, n in zip(_two_analyses(t), "ab"))
    return a.crossJoin(b).select("a", "b", (F.col("b") - F.col("a")).alias("delta"))  # one row each


@query("", "SELECT s_suppkey AS analysis_id, field, was, now FROM (SELECT s_suppkey, 'model' AS field, 'm' || (s_suppkey % 5) AS was, 'm' || (s_suppkey % 3) AS now FROM supplier UNION ALL SELECT s_suppkey, 'version', CASE WHEN s_suppkey % 4 <> 0 THEN 'v' || (s_nationkey % 2) END, 'v' || (s_nationkey % 3) FROM supplier) WHERE was IS DISTINCT FROM now")
def q_pin_drift(t: Tables) -> DataFrame:
    pin = lambda m, v, gap: t.supplier.select(F.col("s_suppkey").alias("analysis_id"), F.concat(F.lit("m"), (F.col("s_suppkey") % m).cast("string")).alias("model"), F.when(F.lit(not gap) | (F.col("s_suppkey") % 4 != 0), F.concat(F.lit("v"), (F.col("s_nationkey") % v).cast("string"))).alias("version"))
    return review.pin_drift(pin(5, 2, True), pin(3, 3, False), ["model", "version"], ["analysis_id"])


@query("nodes_base nodes_head api flows_a", "SELECT (SELECT count(DISTINCT file) FROM (SELECT file FROM nodes_base UNION ALL SELECT file FROM nodes_head)) AS files, (SELECT count(*) FROM nodes_head WHERE kind = 'function') AS functions, (SELECT count(*) FROM api) AS hunks, (SELECT count(DISTINCT flow) FROM flows_a) AS flows, (SELECT count(DISTINCT entity) FROM flows_a) AS entities")
def q_pr_stats(t: Tables) -> DataFrame:
    one = lambda df, c, name: df.agg(c.alias(name))
    out = one(t.nodes("base").select("file").union(t.nodes("head").select("file")), F.countDistinct("file"), "files")
    f = t.flows_a()
    for part in (one(t.nodes("head"), F.count_if(F.col("kind") == "function"), "functions"), f.agg(F.count("*").alias("hunks"), F.countDistinct("flow").alias("flows"), F.countDistinct("entity").alias("entities"))):
        out = out.crossJoin(part)  # one row each
    return out


# ---- cost -----------------------------------------------------------------------------------------------------


def _probe_entities(t: Tables) -> DataFrame:
    v = t.visits()
    visits = v.groupBy("side", "probe", "entity").agg(F.count("*").alias("visits"))
    tokens = v.groupBy("side", "probe").agg(F.round(F.sum("value")).cast("long").alias("tokens_out"))
    return cost.probe_entities(visits, tokens)


@query("probe_e", "SELECT * FROM probe_e")
def q_probe_entity(t: Tables) -> DataFrame:
    return _probe_entities(t)


@query("raw_visits", "SELECT side, probe, entity, count(*) AS visits FROM raw_visits GROUP BY ALL")
def q_probe_visits(t: Tables) -> DataFrame:
    return t.visits().groupBy("side", "probe", "entity").agg(F.count("*").alias("visits"))


@query("probe_e", "SELECT side, entity, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS sessions, CAST(round(sum(visits) + 0.001 * sum(tokens) + 2.0 * count(*), 6) AS DOUBLE) AS cost FROM probe_e GROUP BY side, entity")
def q_entity_totals(t: Tables) -> DataFrame:
    return cost.entity_totals(_probe_entities(t))


_TOTALS = "SELECT side, probe, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(floor(sum(cost) + 0.5) AS BIGINT) AS cost FROM probe_e GROUP BY side, probe"


@query("probe_e", _TOTALS)
def q_probe_totals(t: Tables) -> DataFrame:
    return cost.probe_totals(_probe_entities(t))


_CHANGE = "SELECT probe, entity, CASE WHEN b.{v} IS NOT NULL AND h.{v} IS NOT NULL THEN greatest(h.{v} - b.{v}, 0) WHEN b.{v} IS NULL THEN h.{v} ELSE -b.{v} END AS change FROM (SELECT * FROM probe_e WHERE side = 'base') b FULL JOIN (SELECT * FROM probe_e WHERE side = 'head') h USING (probe, entity)"
_FE = "SELECT DISTINCT 'k' || (CAST(json_extract_string(entity, '$.k') AS BIGINT) % 12) AS flow, entity FROM raw_visits"
_AXES = "SELECT flow, probe, CAST(sign(round(sum(change), 6)) * floor(abs(round(sum(change), 6)) + 0.5) AS BIGINT) AS axis, arg_max(entity, (abs(change), entity)) AS mover FROM ({fe}) JOIN ({ch}) USING (entity) GROUP BY flow, probe"
_AX = _AXES.format(fe=_FE, ch=_CHANGE.format(v="cost"))


def _flow_entities(t: Tables) -> DataFrame:
    return t.visits().select(F.concat(F.lit("k"), (F.get_json_object("entity", "$.k").cast("long") % 12).cast("string")).alias("flow"), "entity").distinct()


def _axes(t: Tables, value: str = "cost") -> DataFrame:
    return cost.axes(cost.attribute(_flow_entities(t), _probe_entities(t), value))


@query("probe_e", f"SELECT * FROM ({_AX}) WHERE axis <> 0")
def q_cost_drivers(t: Tables) -> DataFrame:
    return cost.drivers(_axes(t))


_COST = f"SELECT flow, CAST(coalesce(sum(axis) FILTER (probe = 'click'), 0) AS BIGINT) AS click, CAST(coalesce(sum(axis) FILTER (probe = 'purchase'), 0) AS BIGINT) AS purchase, CAST(coalesce(sum(axis) FILTER (probe = 'view'), 0) AS BIGINT) AS \"view\", CAST(sum(axis) AS BIGINT) AS net FROM ({_AX}) GROUP BY flow"


@query("probe_e", _COST)
def q_cost_flow(t: Tables) -> DataFrame:
    return cost.flow_cost(_axes(t))


@query("probe_e", _AXES.format(fe=_FE, ch=_CHANGE.format(v="tokens")).replace("arg_max(entity, (abs(change), entity)) AS mover", "count(*) AS entities"))
def q_tokens_delta(t: Tables) -> DataFrame:
    a = cost.attribute(_flow_entities(t), _probe_entities(t), "tokens")
    return a.groupBy("flow", "probe").agg(F.round(F.round(F.sum("change"), 6)).cast("long").alias("axis"), F.count("*").alias("entities"))


@query("probe_e", f"SELECT flow, CAST(count(axis) FILTER (axis <> 0) AS BIGINT) AS drivers, CAST(CASE WHEN count(axis) FILTER (axis <> 0) = 0 THEN 0.3 WHEN count(axis) FILTER (axis <> 0) = 1 THEN 0.55 WHEN min(sign(axis)) FILTER (axis <> 0) = max(sign(axis)) FILTER (axis <> 0) THEN 0.85 ELSE 0.55 END AS DOUBLE) AS confidence, CASE WHEN count(axis) FILTER (axis <> 0) >= 2 AND min(sign(axis)) FILTER (axis <> 0) = max(sign(axis)) FILTER (axis <> 0) THEN TRUE ELSE FALSE END AS trusted FROM ({_AX}) GROUP BY flow")
def q_confidence(t: Tables) -> DataFrame:
    return cost.confidence(_axes(t), _flow_entities(t)).select("flow", big("drivers", "drivers"), "confidence", "trusted")


@query("probe_e", f"SELECT (SELECT CAST(sum(net) AS BIGINT) FROM ({_COST})) AS net, (SELECT CAST(sum(cost) AS BIGINT) FROM ({_TOTALS}) WHERE side = 'base') AS base, round((SELECT sum(net) FROM ({_COST})) * 100.0 / CAST((SELECT sum(cost) FROM ({_TOTALS}) WHERE side = 'base') AS DOUBLE), 6) AS net_pct")
def q_pr_cost(t: Tables) -> DataFrame:
    return cost.pr_totals(cost.flow_cost(_axes(t)), cost.probe_totals(_probe_entities(t)))


@query("probe_e", f"SELECT flow, round(least(100.0, abs(net) * 100.0 / CAST((SELECT sum(cost) FROM ({_TOTALS}) WHERE side = 'base') AS DOUBLE)), 6) AS pct FROM ({_COST})")
def q_pct_baseline(t: Tables) -> DataFrame:
    return cost.share_of_baseline(cost.flow_cost(_axes(t)), cost.probe_totals(_probe_entities(t)))


@query("probe_e", f"SELECT CAST(row_number() OVER (ORDER BY abs(net) DESC, flow) AS BIGINT) AS rank, flow, net FROM ({_COST})")
def q_cost_rank(t: Tables) -> DataFrame:
    return cost.contributions(cost.flow_cost(_axes(t))).select(big("rank", "rank"), "flow", "net")


@query("probe_e", f"SELECT side, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS BIGINT) AS cost, min(probe) AS first_probe FROM ({_TOTALS}) GROUP BY side")
def q_baseline(t: Tables) -> DataFrame:
    return cost.probe_totals(_probe_entities(t)).groupBy("side").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.min("probe").alias("first_probe"))


# ---- review ---------------------------------------------------------------------------------------------------


@query("verdicts", """SELECT analysis_id, count(*) AS flows, count(*) FILTER (fit = 'delivers') AS delivers, count(*) FILTER (fit = 'partial') AS partial_fit, count(*) FILTER (fit = 'unrelated') AS unrelated, count(*) FILTER (proof = 'strong') AS strong, count(*) FILTER (proof = 'missing') AS missing,
min(flow_id) FILTER (fit IN ('unrelated', 'partial') OR proof IN ('missing', 'partial')) AS weakest, CASE WHEN analysis_id = 3 THEN 'pending' WHEN analysis_id = 5 THEN 'no-intent' WHEN count(*) FILTER (proof = 'strong' AND TRUE) = count(*) AND count(*) FILTER (fit = 'delivers') = count(*) THEN 'ready' WHEN count(*) FILTER (proof = 'missing' OR fit = 'unrelated') > 0 THEN 'blocked' ELSE 'caution' END AS state FROM verdicts GROUP BY analysis_id""")
def q_ship_readiness(t: Tables) -> DataFrame:
    v = t.verdicts().withColumn("analysing", F.col("analysis_id") == 3).withColumn("has_intent", F.col("analysis_id") != 5)
    return review.ship_readiness(v)


@query("verdicts", "SELECT analysis_id, concat_ws(',', CASE WHEN bool_or(flow_id % 41 = 0) THEN 'proof' END, CASE WHEN bool_or(flow_id % 43 = 0) THEN 'cost' END, CASE WHEN bool_or(flow_id % 47 = 0 AND flow_id % 41 <> 0) THEN 'membership' END) AS axes FROM verdicts GROUP BY analysis_id")
def q_errored_axes(t: Tables) -> DataFrame:
    status = lambda n: F.when(F.col("flow_id") % n == 0, "errored").otherwise("ready")
    v = t.verdicts().select("analysis_id", status(41).alias("proof_status"), status(43).alias("cost_status"), (F.col("flow_id") % 47 != 0).alias("has_membership"))
    return review.errored_axes(v)


@query("verdicts", "SELECT analysis_id, flow_id, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY CASE proof WHEN 'strong' THEN 3 WHEN 'partial' THEN 2 WHEN 'missing' THEN 1 ELSE 0 END DESC, flow_id) AS r FROM verdicts) WHERE r <= 3")
def q_evidence_rank(t: Tables) -> DataFrame:
    strength = F.when(F.col("proof") == "strong", "high").when(F.col("proof") == "partial", "medium").otherwise("low")
    top = review.top_per_group(t.verdicts(), ["analysis_id"], [F.desc(evidence.strength_rank(strength)), F.col("flow_id")], 3)
    return top.select("analysis_id", "flow_id", big("rank", "rank"))


@query("flows_a", "SELECT flow, file, hunks, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY hunks DESC, file) AS r FROM (SELECT flow, file, count(*) AS hunks FROM flows_a GROUP BY flow, file)) WHERE r <= 3")
def q_topk(t: Tables) -> DataFrame:
    by = t.flows_a().groupBy("flow", "file").agg(F.count("*").alias("hunks"))
    return review.top_per_group(by, ["flow"], [F.desc("hunks"), F.col("file")], 3).select("flow", "file", "hunks", big("rank", "rank"))


@query("lines", """SELECT file, line, CAST(sum(starts) OVER (PARTITION BY file ORDER BY line) AS BIGINT) AS block FROM (SELECT *, CASE WHEN near AND NOT coalesce(lag(near) OVER (PARTITION BY file ORDER BY line), FALSE) THEN 1 ELSE 0 END AS starts FROM (SELECT file, line, max(CASE WHEN length(content) % 17 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS near FROM lines)) QUALIFY near""")
def q_context_clip(t: Tables) -> DataFrame:
    marked = t.lines().select("file", "line", (F.length("content") % 17 == 0).alias("changed"))
    return review.around(marked, ["file"], "changed", 3).select("file", "line", big("block", "block"))


# ---- searches, text functions ---------------------------------------------------------------------------------


@query("lines", "SELECT file, count(*) AS matches FROM lines WHERE regexp_matches(content, '(?i)licen[cs]e|copyright') GROUP BY file")
def q_grep_counts(t: Tables) -> DataFrame:
    return tree.grep_counts(t.lines().withColumnRenamed("content", "text"), "(?i)licen[cs]e|copyright")


@query("lines", "SELECT file, line, hit FROM (SELECT file, line, regexp_matches(content, '@mail[0-9]') AS hit, max(CASE WHEN regexp_matches(content, '@mail[0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM lines) WHERE near = 1")
def q_grep_context(t: Tables) -> DataFrame:
    return tree.grep(t.lines().withColumnRenamed("content", "text"), "@mail[0-9]", before=1, after=2).select("file", "line", "hit")


@query("", "SELECT item_id, count(*) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def q_claim_evidence(t: Tables) -> DataFrame:
    return resolve.passages_found(t.benchmark, t.documents).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))


@query("", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS section, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages")
def q_url_parse(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1).alias("section"), F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)").alias("number"))


@query("", "SELECT id, CASE WHEN m % 3 = 0 THEN owner END AS owner, CASE WHEN m % 3 = 0 THEN repo END AS repo, CASE WHEN m % 3 = 0 THEN CAST(m AS INTEGER) END AS number, CASE WHEN m % 3 <> 0 THEN 'NOT_A_PULL_REQUEST' END AS error FROM (SELECT page_id AS id, page_id AS m, 'o' || (page_id % 5) AS owner, 'r' || (page_id % 7) AS repo FROM pages)")
def q_pull_request_url(t: Tables) -> DataFrame:
    p = F.col("page_id")
    url = F.concat(F.lit("https://github.com/o"), (p % 5).cast("string"), F.lit("/r"), (p % 7).cast("string"), F.when(p % 3 == 0, "/pull/").otherwise("/issues/"), p.cast("string"), F.when(p % 2 == 0, "/files").otherwise(""))
    return t.pages.select(p.alias("id"), tx.pull_request(url).alias("x")).select("id", "x.*")


@query("analyses", """SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN m < 60 THEN m || 'm' WHEN h < 48 THEN h || 'h' ELSE CAST(round(h / 24.0) AS BIGINT) || 'd' END AS age FROM (SELECT *, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h FROM (SELECT *, CAST(floor(s / 60.0 + 0.5) AS BIGINT) AS m FROM (SELECT event_id AS id, CAST(greatest(epoch(TIMESTAMP '2024-01-03 00:00:00') - floor(epoch(ts)), 0) AS BIGINT) AS s FROM events)))""")
def q_relative_time(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), tx.relative_time(F.col("ts").cast("timestamp"), F.to_timestamp(F.lit("2024-01-03 00:00:00"))).alias("age"))


@query("nodes_base", r"SELECT file, node_id, 'src/' || string_split(file, '/')[-1] AS resolved, lower(string_split(file, '/')[-1]) AS base FROM nodes_base")
def q_paths(t: Tables) -> DataFrame:
    f = F.col("file")
    messy = F.concat(F.lit("./lib/../"), f)
    return t.nodes("base").select("file", "node_id", tx.resolved_path(messy).alias("resolved"), tx.basename(f).alias("base"))


@query("nodes_base", f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.replace('entity', 'name')}) AS token FROM nodes_base) GROUP BY token")
def q_entity_tokens(t: Tables) -> DataFrame:
    return t.nodes("base").select(F.explode(evidence.entity_tokens(F.col("name"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("", """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'Not signed in' WHEN 1 THEN 'GitHub denied access' WHEN 2 THEN 'PR not found' WHEN 3 THEN 'GitHub rate-limited us' WHEN 4 THEN 'Clone failed' WHEN 5 THEN 'Invalid PR URL' WHEN 6 THEN 'Can''t reach the backend' WHEN 7 THEN 'PR not found' ELSE 'Something went wrong' END AS title, event_id % 9 <> 8 AS has_hint FROM events""")
def q_error_class(t: Tables) -> DataFrame:
    said = F.array(*map(F.lit, ("please Sign In; rate limit", "HTTP 403", "HTTP 404: git failed", "Rate window: LIMIT reached", "git clone: Fatal", "Invalid URL x", "NetworkError", "Not a PR URL", "rate git nothing")))
    x = tx.error_title(F.get(said, (F.col("event_id") % 9).cast("int")))
    return t.events.select("event_id", x["title"].alias("title"), x["hint"].isNotNull().alias("has_hint"))


@query("", "SELECT doc_id, CASE WHEN length(trim(text)) > 80 THEN substr(trim(text), 1, 77) || '…' ELSE trim(text) END AS preview FROM documents")
def q_preview(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("flows_a", "SELECT flow, count(*) AS hits FROM (SELECT DISTINCT flow, entity FROM flows_a WHERE contains(lower(entity), 'red') OR contains(lower(flow), '#1')) GROUP BY flow")
def q_flow_search(t: Tables) -> DataFrame:
    hit = F.contains(F.lower("entity"), F.lit("red")) | F.contains(F.lower("flow"), F.lit("#1"))
    return t.flows_a().where(hit).select("flow", "entity").distinct().groupBy("flow").agg(F.count("*").alias("hits"))


@query("nodes_base nodes_head", "SELECT side, kind, count(*) AS n, count(*) > 200 AS too_large FROM (SELECT 'base' AS side, kind FROM nodes_base UNION ALL SELECT 'head', kind FROM nodes_head) GROUP BY ALL")
def q_list_entities(t: Tables) -> DataFrame:
    both = t.nodes("base").withColumn("side", F.lit("base")).unionByName(t.nodes("head").withColumn("side", F.lit("head")))
    return both.groupBy("side", "kind").agg(F.count("*").alias("n"), (F.count("*") > 200).alias("too_large"))


@query("nodes_base nodes_head", "SELECT name, arg_min(side, (rank, node_id)) AS side, arg_min(node_id, (rank, node_id)) AS node_id FROM (SELECT name, 'head' AS side, 0 AS rank, node_id FROM nodes_head UNION ALL SELECT name, 'base', 1, node_id FROM nodes_base) GROUP BY name")
def q_get_entity(t: Tables) -> DataFrame:
    both = t.nodes("head").select("name", F.lit("head").alias("side"), F.lit(0).alias("rank"), "node_id").union(t.nodes("base").select("name", F.lit("base"), F.lit(1), "node_id"))
    return both.groupBy("name").agg(F.min(F.struct("rank", "node_id", "side")).alias("m")).select("name", "m.side", "m.node_id")


# ---- reports: written from the tables by Spark, then read by the readers ------------------------------------------


@query("cov_base", "SELECT * FROM cov_base WHERE permille > 0 OR TRUE")
def q_lcov_reader(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").where("(doc_id div 20) % 2 = 0").groupBy("source").agg(F.sum("quality").alias("lh"), F.count("*").alias("lf"))
    record = F.format_string("SF:%s\nLF:%d\nLH:%d\nend_of_record\n", "source", "lf", "lh")
    return reports.lcov(rows.select(record.alias("text"))).select("file", "permille")


@query("", "SELECT source AS file, CAST(floor(avg(quality) * 1000 + 0.5) AS BIGINT) AS permille FROM documents JOIN labels USING (doc_id) GROUP BY source")
def q_coverage_json_reader(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").groupBy("source").agg((F.avg("quality") * 100).alias("pct"))
    entry = F.create_map("source", F.struct(F.struct("pct").alias("lines")))
    return reports.coverage_json(rows.select(F.to_json(entry).alias("text"))).select("file", "permille")


@query("diag_head", "SELECT file || '.ts' AS file, code, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM diag_head GROUP BY ALL")
def q_compiler_reader(t: Tables) -> DataFrame:
    line = F.format_string("%s.ts(%d,%d): error %s: it is so", "file", "line", "col", F.concat(F.lit("T"), "code"))
    got = reports.compiler_lines(t.diagnostics("head").select(line.alias("line")))
    return got.groupBy("file", F.substring("code", 2, 9).alias("code")).agg(F.count("*").alias("n"), F.sum("at_line").alias("lines"))


@query("", "SELECT DISTINCT 'src/u' || user_id || '.test.ts' AS file FROM events WHERE event_type = 'error'")
def q_failing_tests_reader(t: Tables) -> DataFrame:
    u = F.col("user_id").cast("string")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("\x1b[31m FAIL \x1b[0m src/u"), u, F.lit(".test.ts > it runs"))).otherwise(F.concat(F.lit("PASS src/u"), u, F.lit(".test.ts")))
    return reports.failing_tests(t.events.select(line.alias("line")))


@query("nodes_base", "SELECT file, CASE WHEN file LIKE 'src/E%' THEN 'core' WHEN length(file) > 12 THEN 'long' END AS package, count(*) AS n FROM nodes_base GROUP BY ALL")
def q_packages(t: Tables) -> DataFrame:
    path = F.concat(F.when(F.col("file").startswith("src/E"), "packages/core/").when(F.length("file") > 12, "packages/core/long/").otherwise("tools/"), "file")
    roots = t.region.where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "packages/core").otherwise("packages/core/long").alias("root"), F.when(F.col("r_regionkey") == 0, "core").otherwise("long").alias("package"))
    nodes = t.nodes("base").select("file", path.alias("path"))
    tagged = reports.packages(nodes.select(F.col("path").alias("file")).distinct(), roots).withColumnRenamed("file", "path")
    return nodes.join(tagged, "path").groupBy("file", "package").agg(F.count("*").alias("n"))


@query("", "SELECT page_id, 'f' || (page_id % 4) AS name, 'v' || page_id AS arg FROM pages")
def q_inline_calls(t: Tables) -> DataFrame:
    p = F.col("page_id")
    text = F.concat(F.lit("so: <tool_call>f"), (p % 4).cast("string"), F.lit("<arg_key>k</arg_key><arg_value> v"), p.cast("string"), F.lit("</arg_value></tool_call> then <tool_call>open"))
    calls = t.pages.select("page_id", F.explode(tx.inline_calls(text)).alias("c"))
    return calls.select("page_id", "c.name", F.col("c.arguments")["k"].alias("arg"))


@query("", "SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL ELSE CAST(page_id AS VARCHAR) END AS k FROM pages")
def q_argument_repair(t: Tables) -> DataFrame:
    p = F.col("page_id").cast("string")
    plain = F.concat(F.lit('{"k": "'), p, F.lit('"}'))
    text = F.when(F.col("page_id") % 4 == 0, plain).when(F.col("page_id") % 4 == 1, F.concat(F.lit("k="), p)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("well &quot;x&quot; "), plain, F.lit(" {"))).otherwise("nothing")
    return t.pages.select("page_id", F.get_json_object(tx.repaired_arguments(text), "$.k").alias("k"))


# ---- tables that change, transcripts, streams' batch twins ------------------------------------------------------------


@query("analyses", "SELECT id, user_id, status FROM analyses ORDER BY updated_at DESC, id DESC LIMIT 50")
def q_recent(t: Tables) -> DataFrame:
    return state.recent(t.analyses()).select("id", "user_id", "status")


@query("analyses", "SELECT count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'errored') AS errored, arg_max(id, (updated_at, id)) FILTER (status = 'ready') AS resume FROM analyses")
def q_feed_stats(t: Tables) -> DataFrame:
    return state.feed_stats(t.analyses())


@query("analyses", "SELECT id, CASE WHEN old THEN 'errored' ELSE status END AS status, CASE WHEN old THEN message || ' · timed out' ELSE message END AS message FROM (SELECT *, status = 'pending' AND updated_at < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 5 MINUTE AS old FROM analyses)")
def q_stale_sweep(t: Tables) -> DataFrame:
    return state.stale_sweep(t.analyses(), "1998-01-01 00:00:00", 5).select("id", "status", "message")


@query("analyses", "SELECT user_id, arg_max(status, (updated_at, id)) AS status, min(updated_at) AS created_at FROM analyses GROUP BY user_id")
def q_upsert(t: Tables) -> DataFrame:
    rows = t.analyses().select("user_id", "status", F.col("updated_at").alias("created_at"), F.struct("updated_at", "id").alias("o"))
    return state.upsert(rows.where("o.id % 2 = 0"), rows.where("o.id % 2 = 1"), ["user_id"], "o", ["created_at"]).select("user_id", "status", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("analyses", "SELECT id, sha256(concat_ws('|', CAST(user_id AS VARCHAR), status, CASE WHEN id % 3 = 0 THEN 'none' ELSE message END)) AS key FROM analyses")
def q_cache_key(t: Tables) -> DataFrame:
    return t.analyses().select("id", state.hash_of(F.col("user_id"), F.col("status"), F.when(F.col("id") % 3 != 0, F.col("message"))).alias("key"))


@query("verdicts", "SELECT flow_id AS flow, CASE WHEN flow_id % 2 = 0 THEN fit END AS fit, CASE WHEN flow_id % 3 = 0 THEN proof END AS proof FROM verdicts")
def q_merge_passes(t: Tables) -> DataFrame:
    v = t.verdicts().withColumnRenamed("flow_id", "flow")
    return state.merge_passes(v.select("flow"), {"fit": (v.where("flow % 2 = 0"), ["fit"]), "proof": (v.where("flow % 3 = 0"), ["proof"])}).select("flow", "fit", "proof")


@query("", "SELECT conv_id, CAST(max(s) AS BIGINT) AS total, count(*) AS calls, min(turn) FILTER (s > 600) AS breach FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role) AS s FROM conversations) GROUP BY conv_id")
def q_budget_audit(t: Tables) -> DataFrame:
    got = state.running_budget(t.conversations, "conv_id", ["turn", "role"], F.length("text"), 600)
    return got.select("conv_id", big("total", "total"), "calls", "breach")


@query("", "SELECT user_id, count(*) AS calls, min(event_id) FILTER (r > 20) AS breach FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY user_id")
def q_call_budget(t: Tables) -> DataFrame:
    return state.running_budget(t.events, "user_id", ["event_id"], F.lit(1), 20).select("user_id", "calls", "breach")


@query("", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts, count(*) AS n FROM events GROUP BY ALL")
def q_turn_progress(t: Tables) -> DataFrame:
    return progress.latest_by_key(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"]).select("user_id", "event_type", "value", "ts", "n")


@query("", "SELECT conv_id, CAST(round(least(100.0, greatest(0.0, (max(turn) - 0.08) / 12.0 * 100)), 6) AS DOUBLE) AS pct FROM conversations GROUP BY conv_id")
def q_progress_percent(t: Tables) -> DataFrame:
    by = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return by.select("conv_id", progress.percent(F.col("turn"), F.lit(12.0)).alias("pct"))


def _calls(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("key"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("event_type") != "error").alias("ok"))


_STEPS = """c AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i, event_type <> 'error' AS ok, CAST(floor(epoch(ts)) AS DOUBLE) AS ts FROM events),
s(key, i, mode, failed, pause, until, refused) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), 'closed', 0, CAST(20 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS BIGINT) FROM c UNION ALL SELECT c.key, c.i,
CASE WHEN mode = 'open' AND ts < until THEN 'open' WHEN ok THEN 'closed' WHEN mode = 'open' OR failed >= 2 THEN 'open' ELSE 'closed' END, CASE WHEN mode = 'open' AND (ts < until OR NOT ok) THEN failed WHEN ok THEN 0 ELSE failed + 1 END,
CASE WHEN mode = 'open' AND ts < until THEN pause WHEN ok THEN 20 WHEN mode = 'open' THEN least(pause * 2, 300) ELSE pause END, CASE WHEN mode = 'open' AND ts < until THEN until WHEN ok THEN 0 WHEN mode = 'open' THEN ts + least(pause * 2, 300) WHEN failed >= 2 THEN ts + pause ELSE 0 END,
refused + CASE WHEN mode = 'open' AND ts < until THEN 1 ELSE 0 END FROM s JOIN c ON c.key = s.key AND c.i = s.i + 1)"""


@query("", "SELECT key, max(i) AS calls, arg_max(refused, i) AS refused, arg_max(mode, i) AS mode FROM s GROUP BY key", _STEPS)
def q_breaker(t: Tables) -> DataFrame:
    return progress.breaker_batch(_calls(t))


def _edited_lines(t: Tables) -> DataFrame:
    """Each document against itself with a word more in every third line."""
    base = t.lines().withColumn("doc", F.substring("file", 2, 20).cast("long"))
    head = base.withColumn("content", F.when(F.col("line") % 3 == 0, F.concat("content", F.lit(" edited"))).otherwise(F.col("content")))
    return lines.line_diff(base, head, "doc")


@query("lines", "SELECT doc, op, count(*) AS n FROM (SELECT CAST(substr(file, 2) AS BIGINT) AS doc, unnest(CASE WHEN line % 3 <> 0 THEN ['keep'] ELSE ['remove', 'add'] END) AS op FROM lines) GROUP BY ALL")
def q_line_diff(t: Tables) -> DataFrame:
    return _edited_lines(t).groupBy("doc", "op").agg(F.count("*").alias("n"))


@query()
def q_word_pairs(t: Tables) -> DataFrame:
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["kind"], F.lit("="), x["text"])), "|")
    return lines.word_pairs(_edited_lines(t), "doc").select("doc", "block", big("k", "k"), "ratio", said("removed_segments").alias("removed"), said("added_segments").alias("added"))


@query("flows_a flows_b", """SELECT 'a' AS side, f.flow, hunks, coalesce(arg_max(j.flow_b, (jaccard, j.flow_b)), (SELECT max(flow) FROM ob)) AS nearest, coalesce(max(jaccard), 0) AS jaccard FROM oa f LEFT JOIN oj j ON j.flow_a = f.flow WHERE f.flow NOT IN (SELECT flow_a FROM paired) GROUP BY f.flow, hunks
UNION ALL SELECT 'b', f.flow, hunks, coalesce(arg_max(j.flow_a, (jaccard, j.flow_a)), (SELECT max(flow) FROM oa)), coalesce(max(jaccard), 0) FROM ob f LEFT JOIN oj j ON j.flow_b = f.flow WHERE f.flow NOT IN (SELECT flow_b FROM paired) GROUP BY f.flow, hunks""", _GREEDY.replace("j AS (", "j AS (SELECT * FROM (", 1).replace("), w AS", ") WHERE a_only > 0 OR shared > 3), w AS", 1) + """, oj AS (SELECT * FROM j), oa AS (SELECT flow, count(DISTINCT hunk_id) AS hunks FROM flows_a GROUP BY flow), ob AS (SELECT flow, count(DISTINCT hunk_id) AS hunks FROM flows_b GROUP BY flow)""")
def q_orphans(t: Tables) -> DataFrame:
    # small flows that lie within another one are left alone, so that both sides have flows that share nothing
    pairs = flows.jaccard_pairs(t.flows_a(), t.flows_b()).where("a_only > 0 or shared > 3")
    return flows.orphans(pairs, flows.greedy_pairs(pairs), t.flows_a(), t.flows_b())


#: Patches of every flow: hunks and entities by their lengths, the one of the name's length in turn wrong in each way.
_PATCHES = """ho AS (SELECT DISTINCT flow, hunk_id, entity FROM flows_a), fl AS (SELECT DISTINCT flow, length(flow) AS n, CAST(string_split(flow, '#')[-1] AS BIGINT) AS k FROM flows_a),
pe AS (SELECT flow, k, CASE WHEN k % 7 = 1 THEN 'Misc' ELSE 'Flow ' || flow END AS name, CASE WHEN k % 7 = 2 THEN '' ELSE 'because' END AS rationale FROM fl),
er AS (SELECT flow, k, CASE k % 7 WHEN 1 THEN 'NAME_RESERVED' WHEN 2 THEN 'RATIONALE_TOO_SHORT' WHEN 3 THEN 'HUNK_NOT_FOUND' WHEN 4 THEN 'ENTITY_NOT_FOUND' END AS error FROM pe UNION ALL SELECT 'no such flow', 0, 'FLOW_NOT_FOUND')"""


def _patches(t: Tables) -> DataFrame:
    own = t.flows_a().groupBy("flow").agg(F.array_sort(F.collect_set("hunk_id")).alias("hs"), F.array_sort(F.collect_set("entity")).alias("es"))
    own = own.withColumn("k", F.element_at(F.split("flow", "#"), -1).cast("long"))
    k = F.col("k") % 7
    by = lambda c, n, r: F.filter(c, lambda x: F.length(x) % n == r)
    patch = own.select(
        "flow", F.when(k == 1, "Misc").otherwise(F.concat(F.lit("Flow "), "flow")).alias("name"), F.when(k == 2, "").otherwise("because").alias("rationale"),
        by("hs", 4, 0).alias("add_hunks"), F.when(k == 3, F.array(F.lit("no such hunk"))).otherwise(by("hs", 2, 0)).alias("remove_hunks"),
        F.when(k == 4, F.array(F.lit("no such entity"))).otherwise(F.array(F.lit("top"), F.lit("low"))).alias("add_entities"), F.array(F.lit("low")).alias("remove_entities"),
    )
    none = F.array().cast("array<string>")
    return patch.union(t.region.where("r_regionkey = 0").select(F.lit("no such flow"), F.lit("A name"), F.lit("because"), none, none, none, none))


def _checked_patches(t: Tables) -> DataFrame:
    a = t.flows_a()
    entities = a.select("entity").union(t.region.where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "top").otherwise("low")))
    return flows.patch_errors(_patches(t), a.select("flow"), a.select("hunk_id"), entities)


@query("flows_a", "SELECT flow, error FROM er", _PATCHES)
def q_patch_errors(t: Tables) -> DataFrame:
    return _checked_patches(t).select("flow", "error")


@query("flows_a", """SELECT flow, 'name' AS part, CASE WHEN error IS NULL THEN 'Flow ' || flow ELSE flow END AS item FROM fl JOIN er USING (flow) UNION ALL
SELECT DISTINCT flow, 'hunk', hunk_id FROM ho JOIN er USING (flow) WHERE error IS NOT NULL OR length(hunk_id) % 2 = 1 UNION ALL
SELECT DISTINCT flow, 'entity', entity FROM ho JOIN er USING (flow) WHERE error IS NULL AND length(hunk_id) % 2 = 1 UNION ALL
SELECT DISTINCT flow, 'entity', entity FROM ho JOIN er USING (flow) WHERE error IS NOT NULL UNION ALL
SELECT flow, 'extra', 'top' FROM fl JOIN er USING (flow) WHERE error IS NULL""", _PATCHES)
def q_mutated_flows(t: Tables) -> DataFrame:
    a = t.flows_a()
    names = a.select("flow").distinct().select("flow", F.col("flow").alias("name"), F.lit("").alias("rationale"))
    own = a.select("flow", "entity").distinct().withColumn("extra", F.lit(False))
    accepted = _checked_patches(t).where("error is null").drop("error")
    named, kept, entities = flows.mutated(names, a.select("flow", "hunk_id").distinct(), own, accepted, a.select("hunk_id", "entity"))
    parts = [named.select("flow", F.lit("name").alias("part"), F.col("name").alias("item")), kept.select("flow", F.lit("hunk"), "hunk_id"), entities.select("flow", F.when(F.col("extra"), "extra").otherwise("entity"), "entity")]
    return parts[0].union(parts[1]).union(parts[2])


# ---- recorded model output, sessions, rendering ---------------------------------------------------------------------


@query("", """SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN NULL WHEN toxic = 1 THEN 'unrelated' ELSE 'delivers' END AS verdict, CASE WHEN doc_id % 5 IN (0, 1) THEN NULL ELSE 'low' END AS strength, CASE WHEN doc_id % 5 IN (0, 1) THEN NULL WHEN doc_id % 2 = 0 THEN doc_id ELSE -1 END AS claim_index,
CASE doc_id % 5 WHEN 0 THEN 'NOT_A_VERDICT' WHEN 1 THEN 'UNKNOWN_VERDICT' END AS error FROM labels""")
def q_verdict_parse(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    v = F.when(d % 5 == 1, "great").when(F.col("toxic") == 1, "unrelated").otherwise("delivers")
    text = F.when(d % 5 == 0, "I think so").otherwise(F.to_json(F.struct(v.alias("verdict"), F.when(d % 2 == 0, d).alias("claim_index"))))
    return transcripts.verdicts(t.labels.select("doc_id", text.alias("text"))).select("doc_id", "verdict", "strength", "claim_index", "error")


@query("", "SELECT page_id, CAST(0 AS BIGINT) AS claim_index, url AS statement, CASE WHEN page_id % 2 = 0 THEN 'test' ELSE 'observation' END AS evidence_type FROM pages")
def q_intent_claims(t: Tables) -> DataFrame:
    claim = lambda s, e: F.struct(s.alias("statement"), e.alias("evidence_type"))
    kind = F.when(F.col("page_id") % 2 == 0, "test").otherwise("rumour")
    text = F.to_json(F.struct(F.array(claim(F.lit("  "), kind), claim(F.col("url"), kind)).alias("claims")))
    return transcripts.intent_claims(t.pages.select("page_id", text.alias("text")), "page_id").select("page_id", big("claim_index", "claim_index"), "statement", "evidence_type")


@query("", "SELECT p_partkey, tool, entity FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'get_entity' WHEN 1 THEN 'neighbors' ELSE 'list_entities' END AS tool, unnest(CASE p_partkey % 3 WHEN 0 THEN [p_name] ELSE list_distinct([p_name, p_brand]) END) AS entity, p_partkey % 7 AS bad FROM part) WHERE bad <> 1 OR tool = 'get_entity'")
def q_touched_entities(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    both = F.array(F.struct(F.col("p_name").alias("name")), F.struct(F.col("p_brand").alias("name")))
    tool = F.when(p % 3 == 0, "get_entity").when(p % 3 == 1, "neighbors").otherwise("list_entities")
    result = F.when(p % 7 == 1, "{broken").when(p % 3 == 1, F.to_json(F.struct(both.alias("nodes")))).otherwise(F.to_json(both))
    return transcripts.touched_entities(t.part.select("p_partkey", tool.alias("tool"), F.col("p_name").alias("argument"), result.alias("result")), "p_partkey")


@query("", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'because ' || role ELSE text END AS content, CASE WHEN turn % 3 = 0 THEN '{}' ELSE '{\"a\": 1}' END AS arguments, CAST(CASE WHEN turn % 2 = 0 THEN 0 ELSE length(text) END AS BIGINT) AS tokens FROM conversations")
def q_responses(t: Tables) -> DataFrame:
    n = F.col("turn")
    rows = t.conversations.select("conv_id", "turn", F.when(n % 2 == 0, " ").otherwise(F.col("text")).alias("content"), F.concat(F.lit("because "), "role").alias("reasoning"), F.lit(0).alias("tool_calls"), F.when(n % 3 == 0, "oops").otherwise('{"a": 1}').alias("arguments"), F.when(n % 2 == 1, F.length("text")).alias("tokens"))
    return transcripts.responses(rows).select("conv_id", "turn", "content", "arguments", big("tokens", "tokens"))


@query("", "SELECT conv_id, count(*) AS turns, CAST(sum(n) AS BIGINT) AS tokens, max(turn_no) >= 4 AS at_limit FROM (SELECT conv_id, length(text) AS n, row_number() OVER w AS turn_no, coalesce(sum(CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)) WHERE stops = 0 AND turn_no <= 4 GROUP BY conv_id")
def q_probe_session(t: Tables) -> DataFrame:
    got = transcripts.until_first_stop(t.conversations, "conv_id", ["turn", "role"], F.length("text") % 3 == 0, 4)
    return got.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("tokens"), F.bool_or("at_limit").alias("at_limit"))


@query("", "SELECT user_id, run, events FROM (SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS events, min(sec) AS f, max(sec) AS l FROM (SELECT *, sum(moved) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS run FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AND row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) > 1 THEN 0 ELSE 1 END AS moved FROM events)) GROUP BY user_id, run) WHERE l - f > 3600")
def q_stuck(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("current"))
    return transcripts.stuck(e, "user_id", 3600).select("user_id", big("run", "run"), "events")


@query("flows_a", "SELECT flow, 'Review ' || count(DISTINCT hunk_id) || ' hunks of ' || flow || '; at most 40 calls.' AS prompt FROM flows_a GROUP BY flow")
def q_prompt(t: Tables) -> DataFrame:
    by = t.flows_a().groupBy("flow").agg(F.countDistinct("hunk_id").alias("n"))
    return by.select("flow", transcripts.render("Review {{hunk_count}} hunks of {{flow}}; at most {{max_tool_calls}} calls.", {"hunk_count": F.col("n"), "flow": F.col("flow"), "max_tool_calls": F.lit(40)}).alias("prompt"))


@query("", "SELECT p_partkey, arg_max(v, length(prefix)) AS value FROM (SELECT p_partkey, p_type || '-' || p_size AS model FROM part) LEFT JOIN (SELECT DISTINCT substr(p_type, 1, 3) AS prefix, 1 AS v FROM part WHERE p_type < 'N' UNION ALL SELECT DISTINCT p_type || '-1', 2 FROM part) d ON starts_with(model, prefix) GROUP BY p_partkey")
def q_model_defaults(t: Tables) -> DataFrame:
    models = t.part.select("p_partkey", F.concat("p_type", F.lit("-"), F.col("p_size").cast("string")).alias("model"))
    defaults = t.part.where("p_type < 'N'").select(F.substring("p_type", 1, 3).alias("prefix"), F.lit(1).alias("value")).distinct().union(t.part.select(F.concat("p_type", F.lit("-1")), F.lit(2)).distinct())
    return transcripts.by_longest_prefix(models, defaults, "model").select("p_partkey", "value")


@query("", """SELECT a.p_partkey AS a_id, b.s_suppkey AS b_id, greatest(a.f, b.f) AS "from", least(a.t, b.t) AS "to" FROM (SELECT p_partkey, p_size % 5 AS key, p_partkey * 3 AS f, p_partkey * 3 + p_size AS t FROM part) a JOIN (SELECT s_suppkey, s_suppkey % 5 AS key, s_suppkey * 11 AS f, s_suppkey * 11 + 90 AS t FROM supplier) b ON a.key = b.key AND a.f < b.t AND b.f < a.t WHERE a.t > a.f""")
def q_span_overlaps(t: Tables) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    a = t.part.select((F.col("p_size") % 5).cast("long").alias("key"), p.alias("a_id"), (p * 3).alias("a_from"), (p * 3 + F.col("p_size")).alias("a_to"))
    b = t.supplier.select((s % 5).alias("key"), s.alias("b_id"), (s * 11).alias("b_from"), (s * 11 + 90).alias("b_to"))
    return transcripts.overlaps(a, b, "key").select("a_id", "b_id", "from", "to")


@query("", "SELECT c_custkey, CASE WHEN m IS NULL THEN 'missing' WHEN m < TIMESTAMP '2000-06-01 00:00:00' - INTERVAL 60 DAY THEN 'stale' ELSE 'fresh' END AS status FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def q_baseline_status(t: Tables) -> DataFrame:
    stored = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("modified_at"))
    return state.baseline_status(t.customer, stored, ["c_custkey"], "2000-06-01 00:00:00")


@query("", "SELECT sha256(url || '|' || 'note ' || page_id || '|' || page_id) AS note_id, 'note ' || page_id AS text FROM pages WHERE page_id % 4 <> 0 AND page_id % 5 <> 0")
def q_notes_edit(t: Tables) -> DataFrame:
    p = F.col("page_id")
    rows = t.pages.select(F.col("url").alias("anchor"), F.when(p % 4 == 0, "  ").otherwise(F.concat(F.lit(" note "), p.cast("string"), F.lit(" "))).alias("text"), p.cast("string").alias("created_at"))
    none = rows.limit(0).select(F.lit("").alias("note_id"), "anchor", "text", "created_at")
    gone = t.pages.where(p % 5 == 0).select(state.hash_of(F.col("url"), F.concat(F.lit("note "), p.cast("string")), p).alias("note_id"))
    return state.edited_notes(none, rows, gone).select("note_id", "text")


_AT = "SELECT doc_id, substr(text, 1, CAST(length(text) // 2 AS INTEGER)) AS p FROM documents WHERE text IS NOT NULL"


@query("", f"SELECT doc_id, CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS BIGINT) AS line, CAST(length(string_split(p, chr(10))[-1]) + length(regexp_replace(string_split(p, chr(10))[-1], '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) + 1 AS BIGINT) AS col FROM ({_AT})")
def q_line_of_offset(t: Tables) -> DataFrame:
    at = tx.position_of(F.col("text"), F.expr("length(text) div 2").cast("int"))
    return t.documents.where("text is not null").select("doc_id", big(at["line"], "line"), big(at["col"], "col"))


@query("nodes_head", "SELECT name, node_id FROM nodes_head WHERE contains(lower(name), 'ring') OR contains(lower(file), 'ring') ORDER BY name, node_id LIMIT 30")
def q_palette_search(t: Tables) -> DataFrame:
    hit = F.contains(F.lower("name"), F.lit("ring")) | F.contains(F.lower("file"), F.lit("ring"))
    return t.nodes("head").where(hit).orderBy("name", "node_id").limit(30).select("name", "node_id")


@query("analyses", "SELECT id, CASE WHEN id % 2 = 0 THEN 2 ELSE 3 END AS fields, status FROM analyses")
def q_document_json(t: Tables) -> DataFrame:
    rows = t.analyses().select("id", "status", F.when(F.col("id") % 2 == 1, F.col("message")).alias("message"))
    text = state.as_document(rows, ["id"])
    return text.select("id", F.size(F.json_object_keys("json")).alias("fields"), F.get_json_object("json", "$.status").alias("status"))
