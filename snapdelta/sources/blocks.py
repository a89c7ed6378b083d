"""Blocks of source text by windows over their delimiters: brackets, keyword blocks, containment, fields, parameters.

A text becomes a stream of tokens with offsets. Each opener raises the running depth, each closer lowers it; among the
delimiters of one level, what follows an opener can only be its own closer. So matching brackets, what encloses
a block, and what comes next after a place are windows over one stream, dealt out by file and sorted by offset, and no
text is walked by hand. Strings and comments are text like any other here, unless ``code_only`` went before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keywords of declarations whose braces hold fields (fixed values).
TS_KEYWORDS, RUST_KEYWORDS = ("interface", "type"), ("struct",)
#: Names that are no fields (fixed values).
NO_FIELDS = ("pub", "fn", "impl", "where", "for", "export", "import")
#: File endings of the two languages (fixed values).
TS_FILES, RUST_FILES = r"\.(ts|tsx|mts|cts)$", r"\.rs$"

#: String literals; as tokens of their own they hide the brackets within.
STRINGS = r'"(?:[^"\\\n]++|\\.)*+"|\'(?:[^\'\\\n]++|\\.)*+\'|`(?:[^`\\]++|\\.)*+`'

_START, _END = "\u0001", "\u0002"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(rows: DataFrame, rx: str, keys: tuple[str, ...] = ("file",), text: str = "content") -> DataFrame:
    """(keys, i, at, token, tail), names that keys must not have: the matches of a pattern from left to right, their offsets (from 1, in characters), and
    the text behind each up to the next. Row 0 has no token and the text before the first match. Null texts give no rows."""
    marked = F.regexp_replace(F.translate(text, _START + _END, "  "), f"({rx})", f"{_START}$1{_END}")
    pieces = rows.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(marked, _START)).alias("i", "piece"))
    before = W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    marks = F.when(F.col("i") > 0, 1).otherwise(0)
    at = F.coalesce(F.sum(F.length("piece") - marks).over(before), F.lit(0)) + 1
    token = F.when(F.col("i") > 0, F.substring_index("piece", _END, 1))
    tail = F.when(F.col("i") > 0, F.substr("piece", F.instr("piece", _END) + 1)).otherwise(F.col("piece"))
    return pieces.select(*keys, "i", at.alias("at"), token.alias("token"), tail.alias("tail"))


def levelled(stream: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """A stream (keys, at, step) with ``depth`` behind each row, the ``level`` of the block it opens or closes (null for a
    step of 0) and, of openers, ``close_at`` (null where it never closes)."""
    s = F.col("step")
    out = stream.withColumn("depth", F.sum("step").over(W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    out = out.withColumn("level", F.when(s == 1, F.col("depth")).when(s == -1, F.col("depth") + 1))
    w = W.partitionBy(*keys, "level").orderBy("at")
    return out.withColumn("close_at", F.when((s == 1) & (F.lead("step").over(w) == -1), F.lead("at").over(w)))


def brackets(rows: DataFrame, opening: str, closing: str, keys: tuple[str, ...] = ("file",), text: str = "content") -> DataFrame:
    """(keys, open_at, close_at, depth, opener) of each opener, by two patterns; one that matches both closes."""
    stream = tokens(rows, f"{closing}|{opening}", keys, text).where("i > 0").withColumn("step", F.when(F.col("token").rlike(f"^(?:{closing})$"), -1).otherwise(1))
    return levelled(stream, keys).where("step = 1").select(*keys, F.col("at").alias("open_at"), "close_at", F.col("level").alias("depth"), F.col("token").alias("opener"))


def enclosing(pairs: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """``brackets`` with ``parent_at``, the opener of the nearest closed block around each: the last opener one level up,
    which is still open. Where that one never closes, neither does any around it, and parent_at is null."""
    as_parent = pairs.select(*keys, F.col("depth").alias("of"), F.col("open_at").alias("at"), F.when(F.col("close_at").isNotNull(), F.col("open_at")).alias("closed"), F.lit(True).alias("leads"))
    as_child = pairs.select(*keys, (F.col("depth") - 1).alias("of"), F.col("open_at").alias("at"), F.lit(None).cast("long").alias("closed"), F.lit(False).alias("leads"), "close_at", "depth", "opener")
    stream = as_parent.unionByName(as_child, allowMissingColumns=True)
    last = F.last(F.when(F.col("leads"), F.struct("closed")), ignorenulls=True).over(W.partitionBy(*keys, "of").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    return stream.withColumn("parent_at", last["closed"]).where("not leads").select(*keys, F.col("at").alias("open_at"), "close_at", "depth", "opener", "parent_at")


def next_of(stream: DataFrame, what: Column, keys: tuple[str, ...]) -> Column:
    """The first ``what`` that is not null behind a row of a stream."""
    return F.last(what, ignorenulls=True).over(W.partitionBy(*keys).orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1))


def cut(rows: DataFrame, spans: DataFrame, parts: dict[str, tuple[str, str]], keys: tuple[str, ...] = ("file",), text: str = "content") -> DataFrame:
    """``spans`` with a text column for each of ``parts``: from one offset to another, both included. Texts and the spans of
    a text meet once."""
    of_text = spans.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in spans.columns if c not in keys])).alias("_spans"))
    met = rows.select(*keys, text).join(of_text, list(keys)).select(*keys, text, F.explode("_spans").alias("_s")).select(*keys, text, "_s.*")
    piece = lambda a, b: F.substr(F.col(text), F.col(a), F.col(b) - F.col(a) + 1)
    return met.select(*spans.columns, *(piece(a, b).alias(name) for name, (a, b) in parts.items()))


def keyword_blocks(files: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """(file, keyword, at, open_at, close_at, header, body) of the blocks that a keyword heads: the first ``{`` behind it
    belongs to it, and of several keywords before one brace the first counts. Blocks that never close have no row;
    where no brace is left, neither has the keyword."""
    stream = tokens(files, rf"[{{}}]|(?<![A-Za-z0-9_])(?:{'|'.join(keywords)}) ").where("i > 0")
    t = F.col("token")
    stream = levelled(stream.withColumn("step", F.when(t == "{", 1).when(t == "}", -1).otherwise(0)))
    brace = next_of(stream, F.when(t == "{", F.struct(F.col("at").alias("open_at"), "close_at")), ("file",))
    found = stream.select("file", "at", t.alias("keyword"), brace.alias("b")).where("keyword not in ('{', '}')").groupBy("file", "keyword", "b").agg(F.min("at").alias("at"))
    found = found.where("b.close_at is not null").select("file", F.rtrim("keyword").alias("keyword"), "at", "b.open_at", "b.close_at")
    ends = found.select("*", (F.col("at") + F.length("keyword") + 1).alias("header_at"), (F.col("open_at") - 1).alias("header_end"), (F.col("open_at") + 1).alias("body_at"), (F.col("close_at") - 1).alias("body_end"))
    out = cut(files, ends, {"header": ("header_at", "header_end"), "body": ("body_at", "body_end")})
    return out.select("file", "keyword", "at", "open_at", "close_at", trimmed(F.col("header")).alias("header"), "body")


def schema_calls(files: DataFrame, callee: str = "z.object") -> DataFrame:
    """(file, at, name, body) of calls bound to a name: ``const NAME = callee(``, where no other ``=`` stands between.

    The body runs from the argument to the first ``)`` that closes what the argument opened, as the original takes it:
    with nested calls, to the end of the first."""
    call = callee.replace(".", r"\.") + r"\("
    stream = tokens(files, rf"{call}|(?:const|let|var)\s+[A-Za-z0-9_]+\s*=|[=()]").where("i > 0")
    t = F.col("token")
    is_call = t == f"{callee}("
    stream = levelled(stream.withColumn("step", F.when(is_call | (t == "("), 1).when(t == ")", -1).otherwise(0)))
    bound = F.last(F.when(t.endswith("="), F.regexp_extract(t, r"\s([A-Za-z0-9_]+)\s*=$", 1)), ignorenulls=True).over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    stream = stream.select("file", "at", "token", "level", "step", bound.alias("name"))
    inner = stream.where(is_call).withColumn("of", F.col("level") + 1).unionByName(stream.where("step = -1").withColumn("of", F.col("level")))
    close = next_of(inner, F.when(F.col("step") == -1, F.col("at")), ("file", "of"))
    found = inner.select("file", "at", "step", "name", close.alias("end")).where("step = 1 and name <> '' and end is not null")
    found = found.select("file", "at", "name", (F.col("at") + len(callee) + 1).alias("body_at"), "end")
    body = F.regexp_replace(trimmed(F.col("body")), r"^\{|\}$", "")
    return cut(files, found, {"body": ("body_at", "end")}).select("file", "at", "name", body.alias("body"))


def parts_at_depth_zero(rows: DataFrame, keys: tuple[str, ...], text: str, separators: str) -> DataFrame:
    """(keys, part, fragment): a text split at separators outside all brackets. ``>`` closes wherever it stands, so that
    behind an arrow nothing is split any more."""
    stream = tokens(rows, rf"[\[\](){{}}<>{separators}]", keys, text)
    t = F.coalesce("token", F.lit(""))
    w = W.partitionBy(*keys).orderBy("at", "i").rowsBetween(W.unboundedPreceding, 0)
    stream = stream.withColumn("depth", F.sum(F.when(t.isin("(", "[", "{", "<"), 1).when(t.isin(")", "]", "}", ">"), -1).otherwise(0)).over(w))
    splits = t.rlike(f"^[{separators}]$") & (F.col("depth") == 0)
    stream = stream.withColumn("splits", splits).withColumn("part", F.sum(F.col("splits").cast("int")).over(w))
    piece = F.concat(F.when(F.col("splits"), "").otherwise(t), "tail")
    by = stream.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("i", piece.alias("x")))).alias("xs"))
    return by.select(*keys, "part", F.array_join(F.transform("xs", lambda p: p["x"]), "").alias("fragment"))


def field_name(fragment: Column) -> Column:
    """The name that a fragment of a body declares; null for comments, attributes, reserved words and what is no name."""
    name = F.regexp_extract(trimmed(fragment), r"^(?:pub )?+\s*+(?:readonly )?+\s*+([A-Za-z_][A-Za-z0-9_]*)\?*(?=[:\s]|$)", 1)
    return F.when((name != "") & ~name.isin(*NO_FIELDS), name)


def parameter_name(fragment: Column) -> Column:
    """The name of a parameter; null for a destructured one."""
    return F.nullif(F.regexp_extract(trimmed(fragment), r"^(?:\.\.\.)*([A-Za-z_][^:=?\s]*)", 1), F.lit(""))


def fields_of(bodies: DataFrame, keys: tuple[str, ...], separators: str) -> DataFrame:
    """(keys, fields) of bodies (keys, body): the distinct names in order; a body without any has an empty list."""
    named = parts_at_depth_zero(bodies, keys, "body", separators).select(*keys, field_name(F.col("fragment")).alias("name"))
    return named.groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("fields"))


def shapes(files: DataFrame) -> DataFrame:
    """(file, type_name, fields) of the data types that source files declare: interfaces, ``type X = {``, bound
    ``z.object(`` calls, and structs. Of one name in a file the last counts: aliases come behind interfaces, calls last."""
    ts, rs = files.where(F.col("file").rlike(TS_FILES)), files.where(F.col("file").rlike(RUST_FILES))
    ident, header = r"^([A-Za-z0-9_]+)", F.col("header")
    blocks = keyword_blocks(ts, TS_KEYWORDS).where((F.col("keyword") == "interface") | header.rlike(ident + r"\s*="))
    rank = F.when(F.col("keyword") == "interface", 0).otherwise(1)
    found = blocks.select("file", rank.alias("rank"), F.col("at").alias("place"), F.regexp_extract(header, ident, 1).alias("type_name"), "body")
    found = found.union(schema_calls(ts).select("file", F.lit(2), "at", "name", "body"))
    structs = keyword_blocks(rs, RUST_KEYWORDS).select("file", F.lit(3), "at", F.regexp_extract(header, ident, 1), "body")

    def last(declared: DataFrame, separators: str) -> DataFrame:
        keys = ("file", "rank", "place", "type_name")
        one = fields_of(declared.where("type_name <> ''"), keys, separators)
        return one.groupBy("file", "type_name").agg(F.max_by("fields", F.struct("rank", "place")).alias("fields"))

    return last(found, r";,\n").union(last(structs.toDF(*found.columns), r",\n"))


def documented_functions(files: DataFrame) -> DataFrame:
    """(file, comment_at, fn, comment, params): each doc comment that a function follows, with nothing but space between. The
    parameters are what stands in the first bracket behind the name."""
    head = r"^\s*(?:export )?\s*(?:async )?\s*function \s*([^(<\s]+)"
    said = tokens(files, r"(?s)/\*(?=\*).*?\*/").where(F.col("tail").rlike(head) & (F.col("i") > 0))
    behind = F.col("at") + F.length("token") + F.length(F.regexp_substr("tail", F.lit(head)))
    said = said.select("file", F.col("at").alias("comment_at"), F.col("token").alias("comment"), F.regexp_extract("tail", head, 1).alias("fn"), (behind - 1).alias("at"))
    opened = brackets(files, r"\(", r"\)").select("file", F.col("open_at").alias("at"), F.struct("open_at", "close_at").alias("bracket"))
    stream = said.unionByName(opened, allowMissingColumns=True)
    met = stream.withColumn("b", next_of(stream, F.col("bracket"), ("file",))).where("fn is not null and b.close_at is not null")
    met = met.select("file", "comment_at", "comment", "fn", (F.col("b.open_at") + 1).alias("a"), (F.col("b.close_at") - 1).alias("z"))
    return cut(files, met, {"params": ("a", "z")}).select("file", "comment_at", "fn", "comment", "params")


def documented_parameters(files: DataFrame) -> DataFrame:
    """(file, comment_at, fn, doc_params, sig_params) of documented functions, in their order; what ``hunks.docs_drift`` compares."""
    from ..functions.text import doc_params

    said = documented_functions(files)
    keys = ("file", "comment_at", "fn")
    named = parts_at_depth_zero(said, keys, "params", ",").withColumn("name", parameter_name(F.col("fragment"))).where("name is not null")
    sig = named.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "name"))), lambda p: p["name"]).alias("sig_params"))
    own = said.select(*keys, doc_params(F.col("comment")).alias("doc_params"))
    return own.join(sig, list(keys), "left").withColumn("sig_params", F.coalesce("sig_params", F.array().cast("array<string>")))


def code_only(content: Column) -> Column:
    """Source text without comments, strings kept."""
    return F.regexp_replace(content, rf"(?s)({STRINGS})|/\*.*?\*/|//[^\n]*+", "$1")


def members(files: DataFrame) -> DataFrame:
    """(file, kind, name, exported, signature) of the methods that classes and interfaces hold, as ``Class.method``; they
    share the export of what holds them. The signature is the first line."""
    code = files.where(F.col("file").rlike(TS_FILES)).select("file", code_only(F.col("content")).alias("content"))
    # what stands between the last end of a statement and the keyword tells whether the class is exported, and on the top level
    stream = tokens(code, STRINGS + r"|[{}]|(?<![A-Za-z0-9_$.])(?:export\s+(?:default\s+)?)?(?:abstract\s+)?(?:class|interface)\s+[A-Za-z_$][A-Za-z0-9_$]*").where("i > 0")
    t = F.col("token")
    stream = levelled(stream.withColumn("step", F.when(t == "{", 1).when(t == "}", -1).otherwise(0)))
    brace = next_of(stream, F.when(t == "{", F.struct(F.col("at").alias("open_at"), "close_at")), ("file",))
    held = stream.select("file", "at", "token", "step", "depth", brace.alias("b")).where((F.col("step") == 0) & (F.col("depth") == 0) & ~t.rlike("^[\"'`]") & F.col("b.close_at").isNotNull())
    held = held.select("file", F.col("at").alias("held_at"), F.col("token").alias("holder"), (F.col("b.open_at") + 1).alias("a"), (F.col("b.close_at") - 1).alias("z"))
    bodies = cut(code, held, {"body": ("a", "z")})
    parts = parts_of_body(bodies, ("file", "held_at", "holder"))
    rx = r"^(?:(?:public|private|protected|static|async|readonly|override|abstract|declare|get|set)\s+)*\*?\s*([A-Za-z_$#][A-Za-z0-9_$]*)\s*\??\s*(?:<[^(]*>)?\("
    fragment = trimmed(F.col("fragment"))
    owner = F.regexp_extract("holder", r"([A-Za-z0-9_$]+)$", 1)
    return parts.where(fragment.rlike(rx)).select("file", F.lit("function").alias("kind"), F.concat_ws(".", owner, F.regexp_extract(fragment, rx, 1)).alias("name"), F.col("holder").startswith("export").alias("exported"), one_line(F.col("head")).alias("signature"))


def one_line(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), r"\s+", " ")


def functions(files: DataFrame) -> DataFrame:
    """(file, kind, name, exported, signature) of top-level functions; the signature runs to the body, over as many lines as
    it takes."""
    code = files.where(F.col("file").rlike(TS_FILES)).select("file", code_only(F.col("content")).alias("content"))
    stream = tokens(code, STRINGS + r"|[\[\](){}]|(?<![A-Za-z0-9_$.])(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*[A-Za-z_$][A-Za-z0-9_$]*").where("i > 0")
    t = F.col("token")
    stream = levelled(stream.withColumn("step", F.when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0)))
    body = next_of(stream, F.when((t == "{") & (F.col("level") == 1), F.col("at")), ("file",))
    found = stream.select("file", "at", "token", "step", "depth", body.alias("body")).where((F.col("step") == 0) & (F.col("depth") == 0) & ~t.rlike("^[\"'`]") & F.col("body").isNotNull())
    found = found.select("file", "token", (F.col("at") + F.coalesce(F.length(F.regexp_substr("token", F.lit(r"^export\s+(?:default\s+)?"))), F.lit(0))).alias("a"), (F.col("body") - 1).alias("z"))
    out = cut(code, found, {"signature": ("a", "z")})
    return out.select("file", F.lit("function").alias("kind"), F.regexp_extract("token", r"([A-Za-z0-9_$]+)$", 1).alias("name"), F.col("token").startswith("export").alias("exported"), one_line(F.col("signature")).alias("signature"))


def all_declarations(files: DataFrame) -> DataFrame:
    """(file, kind, name, exported, signature, variants) of a source tree: functions, methods, types, and states (unions of
    literals). Functions, methods and unions may span lines; other declarations begin on a line of their own."""
    from .tree import declarations, lines_of

    none = F.lit(None).cast("array<string>")
    state = unions(files).select("file", F.lit("state").alias("kind"), "name", "exported", F.lit(None).cast("string").alias("signature"), "variants")
    by_line = declarations(lines_of(files)).where("signature not rlike '^(export )?(default )?(async )?function'").where("kind <> 'state'")
    by_line = by_line.join(state, ["file", "name"], "left_anti").select("file", "kind", "name", "exported", "signature", "variants")
    own = functions(files).union(members(files)).withColumn("variants", none)
    return own.unionByName(by_line).unionByName(state)


def parts_of_body(bodies: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, part, fragment, head): members of a class body, and what stands before the braces of each, split outside round, square and curly brackets at ``;``, at the end
    of a line, and behind a closed block. Angles are left out: an arrow must not hide what follows it."""
    stream = tokens(bodies, STRINGS + r"|[\[\](){};\n]", keys, "body")
    t = F.coalesce("token", F.lit(""))
    w = W.partitionBy(*keys).orderBy("at", "i").rowsBetween(W.unboundedPreceding, 0)
    stream = stream.withColumn("depth", F.sum(F.when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0)).over(w))
    ends = (F.col("depth") == 0) & t.isin(";", "\n", "}")
    # a separator ends its part; the part number counts the ends before a row
    stream = stream.withColumn("part", F.sum(ends.cast("int")).over(w))
    piece = F.concat(F.when(ends, "").otherwise(t), "tail")
    opens = (t == "{") & (F.col("depth") == 1)
    by = stream.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("i", piece.alias("x")))).alias("xs"), F.min(F.when(opens, F.col("i"))).alias("brace"))
    text = lambda xs: F.array_join(F.transform(xs, lambda p: p["x"]), "")
    head = F.filter("xs", lambda p: F.col("brace").isNull() | (p["i"] < F.col("brace")))
    return by.select(*keys, "part", text(F.col("xs")).alias("fragment"), text(head).alias("head"))


def unions(files: DataFrame) -> DataFrame:
    """(file, name, exported, variants) of type aliases that are unions of string literals, over as many lines as they take."""
    literal = r"(?:\"[^\"\n]*+\"|'[^'\n]*+')"
    rx = rf"(?<![A-Za-z0-9_$])(export\s+)?type\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*((?:\|\s*)?{literal}(?:\s*\|\s*{literal})*)(?=\s*(?:;|\n|$))"
    code = files.select("file", code_only(F.col("content")).alias("content"))
    part = lambda i: F.regexp_extract_all("content", F.lit(rx), F.lit(i))
    found = code.select("file", F.explode(F.arrays_zip(part(1).alias("e"), part(2).alias("name"), part(3).alias("u"))).alias("x"))
    variants = F.transform(F.regexp_extract_all("x.u", F.lit(literal), F.lit(0)), lambda v: F.substr(v, F.lit(2), F.length(v) - 2))
    return found.select("file", F.col("x.name").alias("name"), (F.col("x.e") != "").alias("exported"), variants.alias("variants"))


def containment_edges(declared: DataFrame) -> DataFrame:
    """(src, dst, kind): a file defines each of its declarations (file, name, exported), and exports those marked so."""
    end = declared.select(F.col("file").alias("src"), F.concat_ws("#", "file", "name").alias("dst"), "exported")
    return end.select("src", "dst", F.lit("defines").alias("kind")).union(end.where("exported").select("src", "dst", F.lit("exports")))


def transition_literals(files: DataFrame) -> DataFrame:
    """(file, at, from, to): ``if (x === "a")``, either way round and behind ``else`` too, and each literal that its block or
    its one statement returns or assigns, in nested blocks as well. Declarations with a value are no assignments."""
    literal = r"[\"'][^\"'\n]*[\"']"
    test = rf"(?<![A-Za-z0-9_$.])if\s*\(\s*(?:[\w.$\[\]]+\s*===?\s*{literal}|{literal}\s*===?\s*[\w.$\[\]]+)\s*\)"
    code = files.select("file", code_only(F.col("content")).alias("content"))
    stream = tokens(code, rf"{test}|{STRINGS}|[{{}}]").where("i > 0")
    t = F.col("token")
    stream = levelled(stream.withColumn("step", F.when(t == "{", 1).when(t == "}", -1).otherwise(0)))
    after = F.col("at") + F.length(t) + F.length("tail")
    brace = next_of(stream, F.when(t.isin("{", "}") | t.startswith("if"), F.struct("at", "close_at", (t == "{").alias("opens"))), ("file",))
    tests = stream.select("file", "at", "token", "tail", after.alias("next"), brace.alias("b")).where(t.startswith("if"))
    is_block = F.coalesce(F.col("b.opens") & (F.col("b.at") == F.col("next")) & ~F.col("tail").rlike(r"\S"), F.lit(False))
    end = F.when(is_block, F.col("b.close_at")).otherwise(F.coalesce(F.col("b.at") - 1, F.lit(1 << 30)))
    spans = tests.select("file", F.col("at").alias("test_at"), F.regexp_extract("token", r"[\"']([^\"'\n]*)[\"']", 1).alias("from"), is_block.alias("block"), (F.col("at") + F.length("token")).alias("a"), end.cast("int").alias("z")).where("z is not null")
    met = cut(code, spans, {"body": ("a", "z")})
    body = F.when(F.col("block"), F.col("body")).otherwise(F.regexp_extract("body", rf"(?s)^((?:{STRINGS}|[^;])*+;?)", 1))
    target = r"(?:const|let|var)\s+[\w$]+\s*(?::[^=;]*)?=\s*[\"'][^\"'\n]*[\"']|(?:(?<![\w$.])return\s+|[\w$\])]\s*=\s*)[\"']([^\"'\n]*)[\"'](?=\s*(?:[;,)}\n]|$))"
    return met.select("file", F.col("test_at").alias("at"), "from", F.explode(F.regexp_extract_all(body, F.lit(target), F.lit(1))).alias("to")).where("to <> ''")
