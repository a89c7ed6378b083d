"""Snapshot-shaped views of the driver's tables, and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hunks import api_delta


class Tables:
    """The tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def nodes(self, side: str) -> DataFrame:
        p = F.col("p_partkey")
        signature = F.concat("p_type", F.lit("("), F.col("p_size").cast("string"), F.lit(")"))
        if side == "head":
            signature = F.concat(signature, F.when(p % 7 == 0, "#v2").otherwise(""))
        return self.part.where(p % 10 != (0 if side == "base" else 1)).select(
            p.alias("node_id"), F.concat(F.lit("src/"), "p_type", F.lit(".ts")).alias("file"), F.concat("p_brand", F.lit("."), "p_name").alias("name"),
            signature.alias("signature"), F.when(p % 5 == 0, "type").otherwise("function").alias("kind"),
        )

    def exports(self) -> DataFrame:
        return self.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("node_id")).distinct()

    def edges(self, side: str) -> DataFrame:
        a = self.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), "l_shipdate")
        b = self.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
        when = "l_shipdate < timestamp_ntz'2000-01-01'" if side == "base" else "l_shipdate >= timestamp_ntz'1996-01-01'"
        return a.where(when).join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()

    def variants(self, side: str) -> DataFrame:
        when = "ts < timestamp_ntz'2024-01-16'" if side == "base" else "ts >= timestamp_ntz'2024-01-16'"
        u = F.col("user_id")
        rows = self.events.where(when).select(F.concat(F.lit("u"), (u % 10).cast("string")).alias("file"), F.concat(F.lit("S"), u.cast("string")).alias("name"), F.concat("event_type", F.hour("ts").cast("string")).alias("event_type")).distinct()
        return rows.groupBy("file", "name").agg(F.array_sort(F.collect_list("event_type")).alias("variants"))

    def files(self, side: str) -> DataFrame:
        return self.pages.where(F.col("page_id") % 3 != (0 if side == "base" else 1)).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file"), F.col("html").alias("content"))

    def needles(self) -> DataFrame:
        return self.spark.createDataFrame([("script", "<script"), ("track", "track("), ("ad", 'class="ad"'), ("table", "<table")], "primitive string, needle string")

    def shapes(self, side: str) -> DataFrame:
        when = "o_orderdate < timestamp_ntz'1999-01-01'" if side == "base" else "o_orderdate >= timestamp_ntz'1997-01-01'"
        rows = self.customer.join(self.orders.where(when), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("file"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("type_name"), "o_orderpriority").distinct()
        return rows.groupBy("file", "type_name").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("fields"))

    def diagnostics(self, side: str) -> DataFrame:
        e = F.col("event_id")
        return self.events.where((F.col("event_type") == "error") & (e % 3 != (0 if side == "base" else 1))).select(
            F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), (F.hour("ts") + 1).cast("long").alias("line"),
            F.get_json_object("props", "$.k").cast("long").alias("col"), F.concat(F.lit("E"), (e % 7).cast("string")).alias("code"),
        )

    def coverage(self, side: str) -> DataFrame:
        rows = self.documents.join(self.labels, "doc_id").where(F.expr("(doc_id div 20) % 2") == (0 if side == "base" else 1))
        by = rows.groupBy(F.col("source").alias("file")).agg(F.sum("quality").alias("hit"), F.count("*").alias("all"))
        return by.select("file", F.expr("hit * 1000 div `all`").alias("permille"))

    def visits(self) -> DataFrame:
        rows = self.events.where("event_type in ('view', 'click', 'purchase')")
        side = F.when(F.expr("ts < timestamp_ntz'2024-01-16'"), "base").otherwise("head")
        return rows.select(side.alias("side"), F.col("event_type").alias("probe"), F.col("props").alias("entity"), "value")

    def api_hunks(self) -> DataFrame:
        """(hunk_id, entity, file, signature) of the exported functions whose signature differs."""
        d = api_delta(self.nodes("base"), self.nodes("head"), self.exports(), self.exports())
        return d.select(F.concat("file", F.lit("|"), "name").alias("hunk_id"), F.col("name").alias("entity"), "file", F.coalesce("after_signature", "before_signature").alias("signature"), "status")

    def flows_a(self) -> DataFrame:
        return self.api_hunks().select(F.split_part("entity", F.lit("."), F.lit(1)).alias("flow"), "hunk_id", "entity", "file", "signature")

    def flows_b(self) -> DataFrame:
        return self.api_hunks().select(F.col("file").alias("flow"), "hunk_id", "entity")

    def verdicts(self) -> DataFrame:
        return self.labels.select(
            (F.col("doc_id") % 20).alias("analysis_id"), F.col("doc_id").alias("flow_id"), F.when(F.col("toxic") == 1, "unrelated").when(F.col("quality") == 1, "delivers").otherwise("partial").alias("fit"),
            F.when(F.col("doc_id") % 3 == 0, "partial").when(F.col("quality") == 0, "missing").otherwise("strong").alias("proof"),
        )

    def analyses(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "ready").otherwise("errored").alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.col("o_orderpriority").alias("message"))

    def lines(self) -> DataFrame:
        return self.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "content")).withColumn("line", (F.col("line") + 1).cast("long"))


#: The views as DuckDB table expressions; a query's SQL names those it needs.
SQL: dict[str, str] = {
    "nodes_base": "SELECT p_partkey AS node_id, 'src/' || p_type || '.ts' AS file, p_brand || '.' || p_name AS name, p_type || '(' || p_size || ')' AS signature, CASE WHEN p_partkey % 5 = 0 THEN 'type' ELSE 'function' END AS kind FROM part WHERE p_partkey % 10 <> 0",
    "nodes_head": "SELECT p_partkey AS node_id, 'src/' || p_type || '.ts' AS file, p_brand || '.' || p_name AS name, p_type || '(' || p_size || ')' || CASE WHEN p_partkey % 7 = 0 THEN '#v2' ELSE '' END AS signature, CASE WHEN p_partkey % 5 = 0 THEN 'type' ELSE 'function' END AS kind FROM part WHERE p_partkey % 10 <> 1",
    "exports": "SELECT DISTINCT l_partkey AS node_id FROM lineitem WHERE l_returnflag = 'R'",
    "edges_base": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey AND a.l_shipdate < TIMESTAMP '2000-01-01'",
    "edges_head": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey AND a.l_shipdate >= TIMESTAMP '1996-01-01'",
    "named_base": "SELECT e.src, e.dst, s.file AS caller_file, s.name AS caller_name, t.name AS callee_name FROM edges_base e JOIN nodes_base s ON s.node_id = e.src JOIN nodes_base t ON t.node_id = e.dst",
    "named_head": "SELECT e.src, e.dst, s.file AS caller_file, s.name AS caller_name, t.name AS callee_name FROM edges_head e JOIN nodes_head s ON s.node_id = e.src JOIN nodes_head t ON t.node_id = e.dst",
    "var_base": "SELECT DISTINCT 'u' || (user_id % 10) AS file, 'S' || user_id AS name, event_type || extract(hour FROM ts) AS item FROM events WHERE ts < TIMESTAMP '2024-01-16'",
    "var_head": "SELECT DISTINCT 'u' || (user_id % 10) AS file, 'S' || user_id AS name, event_type || extract(hour FROM ts) AS item FROM events WHERE ts >= TIMESTAMP '2024-01-16'",
    "needles": "SELECT * FROM (VALUES ('script', '<script'), ('track', 'track('), ('ad', 'class=\"ad\"'), ('table', '<table')) v(primitive, needle)",
    "hits_base": "SELECT 'p' || page_id AS file, primitive FROM pages, needles WHERE page_id % 3 <> 0 AND contains(html, needle)",
    "hits_head": "SELECT 'p' || page_id AS file, primitive FROM pages, needles WHERE page_id % 3 <> 1 AND contains(html, needle)",
    "shape_base": "SELECT DISTINCT 'n' || c_nationkey AS file, 'C' || c_custkey AS type_name, o_orderpriority AS item FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '1999-01-01'",
    "shape_head": "SELECT DISTINCT 'n' || c_nationkey AS file, 'C' || c_custkey AS type_name, o_orderpriority AS item FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01'",
    "diag_base": "SELECT 'f' || user_id AS file, CAST(hour(ts) + 1 AS BIGINT) AS line, CAST(json_extract_string(props, '$.k') AS BIGINT) AS col, 'E' || (event_id % 7) AS code FROM events WHERE event_type = 'error' AND event_id % 3 <> 0",
    "diag_head": "SELECT 'f' || user_id AS file, CAST(hour(ts) + 1 AS BIGINT) AS line, CAST(json_extract_string(props, '$.k') AS BIGINT) AS col, 'E' || (event_id % 7) AS code FROM events WHERE event_type = 'error' AND event_id % 3 <> 1",
    "cov_base": "SELECT source AS file, CAST(sum(quality) * 1000 // count(*) AS BIGINT) AS permille FROM documents JOIN labels USING (doc_id) WHERE (doc_id // 20) % 2 = 0 GROUP BY source",
    "cov_head": "SELECT source AS file, CAST(sum(quality) * 1000 // count(*) AS BIGINT) AS permille FROM documents JOIN labels USING (doc_id) WHERE (doc_id // 20) % 2 = 1 GROUP BY source",
    "raw_visits": "SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'base' ELSE 'head' END AS side, event_type AS probe, props AS entity, value FROM events WHERE event_type IN ('view', 'click', 'purchase')",
    "probe_e": """SELECT v.side, v.probe, v.entity, v.visits, CAST(floor(v.visits * t.tokens_out / CAST(t.all_visits AS DOUBLE) + 0.5) AS BIGINT) AS tokens,
        CAST(round(v.visits + 0.001 * CAST(floor(v.visits * t.tokens_out / CAST(t.all_visits AS DOUBLE) + 0.5) AS BIGINT) + 2, 6) AS DOUBLE) AS cost
        FROM (SELECT side, probe, entity, count(*) AS visits FROM raw_visits GROUP BY ALL) v
        JOIN (SELECT side, probe, count(*) AS all_visits, CAST(round(sum(value)) AS BIGINT) AS tokens_out FROM raw_visits GROUP BY ALL) t USING (side, probe)""",
    "api_b": "SELECT file, name, arg_max(signature, node_id) AS s FROM nodes_base WHERE kind = 'function' AND node_id IN (SELECT node_id FROM exports) GROUP BY ALL",
    "api_h": "SELECT file, name, arg_max(signature, node_id) AS s FROM nodes_head WHERE kind = 'function' AND node_id IN (SELECT node_id FROM exports) GROUP BY ALL",
    "api": "SELECT file, name, b.s AS before_signature, h.s AS after_signature, CASE WHEN b.s IS NULL THEN 'added' WHEN h.s IS NULL THEN 'removed' ELSE 'changed' END AS status FROM api_b b FULL JOIN api_h h USING (file, name) WHERE b.s IS DISTINCT FROM h.s",
    "flows_a": "SELECT split_part(name, '.', 1) AS flow, file || '|' || name AS hunk_id, name AS entity, file, coalesce(after_signature, before_signature) AS signature FROM api",
    "flows_b": "SELECT file AS flow, file || '|' || name AS hunk_id, name AS entity FROM api",
    "verdicts": "SELECT doc_id % 20 AS analysis_id, doc_id AS flow_id, CASE WHEN toxic = 1 THEN 'unrelated' WHEN quality = 1 THEN 'delivers' ELSE 'partial' END AS fit, CASE WHEN doc_id % 3 = 0 THEN 'partial' WHEN quality = 0 THEN 'missing' ELSE 'strong' END AS proof FROM labels",
    "analyses": "SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'ready' ELSE 'errored' END AS status, o_orderdate AS updated_at, o_orderpriority AS message FROM orders",
    "lines": "SELECT 'd' || doc_id AS file, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line, unnest(string_split(text, chr(10))) AS content FROM documents",
}
_NEEDS = {
    "named_base": ["edges_base", "nodes_base"], "named_head": ["edges_head", "nodes_head"], "hits_base": ["needles"], "hits_head": ["needles"], "probe_e": ["raw_visits"],
    "api_b": ["nodes_base", "exports"], "api_h": ["nodes_head", "exports"], "api": ["api_b", "api_h"], "flows_a": ["api"], "flows_b": ["api"],
}


def with_views(names: str, query: str, extra: str = "") -> str:
    """A query with the views it names (and those they need) as common table expressions."""
    done: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in done:
            done.append(name)

    for name in names.split():
        need(name)
    parts = [f"{n} AS ({SQL[n]})" for n in done] + ([extra] if extra else [])
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + query
