"""Registered queries of source text: blocks, containment, shapes, documented parameters, members. Pages are read as
they are; source files are written out of the columns of part and supplier, some fifty declarations a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import hunks
from ..sources import blocks
from .queries import _SETS, big, joined, query
from .views import Tables

#: Tags that hold blocks of a page.
TAGS = "article|div|li|nav|table|td|th|tr|ul"
OPENING, CLOSING = rf"<(?:{TAGS})(?:\s[^>]*)?>", rf"</(?:{TAGS})\s*>"

_TAGS = rf"""tok AS (SELECT page_id, i, x, 1 + coalesce(sum(length(x)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM (SELECT page_id, unnest(p) AS x, unnest(range(len(p))) AS i FROM (SELECT page_id, string_split(regexp_replace(html, '({CLOSING}|{OPENING})', chr(1) || '\1', 'g'), chr(1)) AS p FROM pages))),
st AS (SELECT *, CASE WHEN x LIKE '</%' THEN -1 ELSE 1 END AS step FROM tok WHERE i > 0),
dp AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM st),
lv AS (SELECT *, CASE WHEN step = 1 THEN depth ELSE depth + 1 END AS level FROM dp),
br AS (SELECT page_id, pos, step, level, regexp_extract(x, '^<([a-z]+)', 1) AS name, lead(step) OVER w AS s2, lead(pos) OVER w AS p2 FROM lv WINDOW w AS (PARTITION BY page_id, level ORDER BY pos)),
pairs AS (SELECT page_id, CAST(pos AS BIGINT) AS open_at, CAST(CASE WHEN s2 = -1 THEN p2 END AS BIGINT) AS close_at, CAST(level AS BIGINT) AS depth, name FROM br WHERE step = 1)"""


def _pairs(t: Tables) -> DataFrame:
    return blocks.brackets(t.pages, OPENING, CLOSING, ("page_id",), "html")


@query("", "SELECT page_id, name, open_at, close_at, depth, sha256(substr(html, open_at, close_at - open_at)) AS body FROM pairs JOIN pages USING (page_id) WHERE close_at IS NOT NULL", _TAGS)
def q_blocks(t: Tables) -> DataFrame:
    closed = _pairs(t).where("close_at is not null").withColumn("last", F.col("close_at") - 1)
    found = blocks.cut(t.pages, closed, {"body": ("open_at", "last")}, ("page_id",), "html")
    return found.select("page_id", F.regexp_extract("opener", "^<([a-z]+)", 1).alias("name"), big("open_at", "open_at"), big("close_at", "close_at"), big("depth", "depth"), F.sha2("body", 256).alias("body"))


@query("", "SELECT c.page_id, c.open_at, max(p.open_at) AS parent_at FROM pairs c LEFT JOIN pairs p ON p.page_id = c.page_id AND p.open_at < c.open_at AND p.close_at > c.open_at GROUP BY ALL", _TAGS)
def q_containment(t: Tables) -> DataFrame:
    return blocks.enclosing(_pairs(t), ("page_id",)).select("page_id", big("open_at", "open_at"), big("parent_at", "parent_at"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _sources(t: Tables, side: str) -> DataFrame:
    """(file, content): each part is an interface, an alias, a bound schema call or a documented function."""
    k, p = F.col("p_partkey"), F.col("p_partkey").cast("string")
    kind, no = k % 4, F.expr("p_partkey div 4")
    head = F.lit(side == "head")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    declared = (
        F.when(kind == 0, _text("export interface P", p, " {\n  ", F.when(head & (no % 3 == 0), "key").otherwise("id"), ": number;\n  ", word, "?: string; // ", F.col("p_brand"), "\n  nested: { a: number; b: [x, y] };\n", F.when(k % 8 == 0, "  readonly size: number,\n").otherwise(""), "}\n"))
        .when(kind == 1, _text("type U", p, ' = "a" | "b";\ntype T', p, " = { on: boolean, ", F.when(head & (no % 5 == 0), "off?: boolean, ").otherwise(""), "cb: (x: A) => void, hidden: B };\n"))
        .when(kind == 2, _text("export const S", p, " = z.object({ ", F.when(head & (no % 2 == 0), "sid").otherwise("id"), ": z.string(), n: z.number() });\n"))
        .otherwise(_text("/**\n * Uses ", F.col("p_name"), ".\n * @param a first\n * @param {number} b second\n */\nexport async function f", p, "(a: string, ", F.when(no % 3 == 0, "b: Map<string, number> = new Map()").when(no % 3 == 1, "{ c, d }: O, e = 1").otherwise("b?: number, ...rest: string[]"), ") {}\n"))
    )
    rows = t.part.where(k % 10 != (0 if side == "base" else 1)).select(F.format_string("src/f%d.ts", F.expr("p_partkey div 50")).alias("file"), k.alias("k"), declared.alias("d"))
    texts = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("ds"))
    return texts.select("file", F.array_join(F.transform("ds", lambda x: x["d"]), "\n").alias("content"))


def _shape_sql(side: str) -> str:
    head = "TRUE" if side == "head" else "FALSE"
    return f"""SELECT 'src/f' || (p_partkey // 50) || '.ts' AS file, CASE p_partkey % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'U' ELSE 'S' END || p_partkey AS type_name, unnest(CASE p_partkey % 4
  WHEN 0 THEN list_distinct([CASE WHEN {head} AND p_partkey // 4 % 3 = 0 THEN 'key' ELSE 'id' END, split_part(p_name, ' ', 1), 'nested'] || CASE WHEN p_partkey % 8 = 0 THEN ['size'] ELSE [] END)
  WHEN 1 THEN ['on', 'cb'] || CASE WHEN {head} AND p_partkey // 4 % 5 = 0 THEN ['off'] ELSE [] END
  ELSE [CASE WHEN {head} AND p_partkey // 4 % 2 = 0 THEN 'sid' ELSE 'id' END] END) AS item FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 10 <> {0 if side == "base" else 1}"""


@query("", "SELECT file, type_name, string_agg(item, ',' ORDER BY item) AS fields FROM sh GROUP BY ALL", f"sh AS ({_shape_sql('head')})")
def q_fields(t: Tables) -> DataFrame:
    return blocks.shapes(_sources(t, "head")).select("file", "type_name", joined("fields"))


@query("", f"""SELECT file, type_name, CASE WHEN na = 1 AND nr = 1 THEN '' ELSE coalesce(added, '') END AS added, CASE WHEN na = 1 AND nr = 1 THEN '' ELSE coalesce(removed, '') END AS removed,
CASE WHEN na = 1 AND nr = 1 THEN removed END AS renamed_from, CASE WHEN na = 1 AND nr = 1 THEN added END AS renamed_to FROM ({_SETS.format(name='type_name', b='sb', h='sh')}) WHERE na + nr > 0""", f"sb AS ({_shape_sql('base')}), sh AS ({_shape_sql('head')})")
def q_source_data_delta(t: Tables) -> DataFrame:
    sides = [blocks.shapes(_sources(t, s)) for s in ("base", "head")]
    return hunks.data_delta(*sides).select("file", "type_name", joined("added"), joined("removed"), "renamed_from", "renamed_to")


_DOCS = "SELECT 'src/f' || (p_partkey // 50) || '.ts' AS file, 'f' || p_partkey AS fn, CASE p_partkey // 4 % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'a,e' ELSE 'a,b,rest' END AS sig FROM part WHERE p_partkey % 4 = 3 AND p_partkey % 10 <> 1"


@query("", "SELECT file, fn, 'a,b' AS doc, sig FROM d", f"d AS ({_DOCS})")
def q_params(t: Tables) -> DataFrame:
    return blocks.documented_parameters(_sources(t, "head")).select("file", "fn", joined("doc_params", "doc"), joined("sig_params", "sig"))


@query("", "SELECT file, fn, CASE sig WHEN 'a,e' THEN 'param-names' ELSE 'param-count' END AS drift FROM d WHERE sig <> 'a,b'", f"d AS ({_DOCS})")
def q_docs_pairs(t: Tables) -> DataFrame:
    return hunks.docs_drift(blocks.documented_parameters(_sources(t, "head")))


def _classes(t: Tables) -> DataFrame:
    """(file, content): each supplier is a class, a function over several lines, and a union of literals."""
    s = F.col("s_suppkey").cast("string")
    export = F.when(F.col("s_suppkey") % 2 == 0, "export ").otherwise("")
    declared = _text(
        "// class No", s, " { never() {} }\n", export, "class C", s, ' extends Base<X> {\n  url = "http://x//{', F.col("s_name"), '";\n  run = (e: Event) => { this.go(e); };\n  constructor(private id: number) { super(); }\n  async go(\n    a: string,\n    { b }: O,\n  ): Promise<void> {\n    if (a) { inner(b); }\n  }\n}\n',
        export, "function f", s, "(\n  a: number,\n): void {\n  class Local { m() {} }\n}\nexport type M", s, ' =\n  | "n', F.col("s_nationkey").cast("string"), "\"\n  | 'off';\n",
    )
    rows = t.supplier.select(F.format_string("src/s%d.ts", F.expr("s_suppkey div 20")).alias("file"), "s_suppkey", declared.alias("d"))
    texts = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "d"))).alias("ds"))
    return texts.select("file", F.array_join(F.transform("ds", lambda x: x["d"]), "").alias("content"))


_DECLARED = """de AS (SELECT 'src/s' || (s_suppkey // 20) || '.ts' AS file, x.kind, x.name || s_suppkey || x.member AS name, CASE WHEN x.kind = 'state' THEN TRUE ELSE s_suppkey % 2 = 0 END AS exported,
  CASE WHEN x.member <> '' THEN x.sig WHEN x.kind = 'function' THEN 'function f' || s_suppkey || '( a: number, ): void' WHEN x.kind = 'type' THEN CASE WHEN s_suppkey % 2 = 0 THEN 'export ' ELSE '' END || 'class C' || s_suppkey || ' extends Base<X>' END AS signature, CASE WHEN x.kind = 'state' THEN 'n' || s_nationkey || ',off' END AS variants
  FROM supplier, (VALUES ('type', 'C', '', NULL), ('function', 'C', '.constructor', 'constructor(private id: number)'), ('function', 'C', '.go', 'async go( a: string, { b }: O, ): Promise<void>'), ('function', 'f', '', NULL), ('state', 'M', '', NULL)) x(kind, name, member, sig))"""


@query("", "SELECT * FROM de", _DECLARED)
def q_declarations(t: Tables) -> DataFrame:
    return blocks.all_declarations(_classes(t)).select("file", "kind", "name", "exported", "signature", joined("variants"))


@query("", "SELECT file AS src, file || '#' || name AS dst, 'defines' AS kind FROM de UNION ALL SELECT file, file || '#' || name, 'exports' FROM de WHERE exported", _DECLARED)
def q_defines(t: Tables) -> DataFrame:
    return blocks.containment_edges(blocks.all_declarations(_classes(t)))
