"""Source trees as tables: files, lines, declarations, imports, and searches over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folders that are not looked into.
PRUNED = ("node_modules", "dist", "target", ".git")


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("ts", "tsx")) -> DataFrame:
    """(file, content) of the source files under a folder, on any file system that Spark reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    path, below = F.col("path"), re.sub(r"^[a-z]+:/*(?=/)", "", root.rstrip("/"))
    kept = rows.where(~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, PRUNED))))
    return kept.select(F.regexp_replace(path, "^.*?" + re.escape(below) + "/", "").alias("file"), F.decode("content", "UTF-8").alias("content"))


def lines_of(files: DataFrame, key: str = "file", content: str = "content") -> DataFrame:
    """(key, line, text), lines from 1."""
    return files.select(key, F.posexplode(F.split(content, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def declarations(lines: DataFrame) -> DataFrame:
    """(file, line, kind, name, exported, signature) of top-level declarations, by one pattern a kind.

    A reading by lines, not a parser: declarations that begin on a line of their own are found."""
    rx = r"^(export\s+)?(?:default\s+)?(?:abstract\s+)?(async\s+function|function|class|interface|type|enum|const)\s+([A-Za-z_$][\w$]*)"
    word = F.regexp_extract("text", rx, 2)
    kind = F.when(word.endswith("function"), "function").when((word == "const") & F.col("text").rlike(r"=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"), "function").when((word == "type") & F.col("text").rlike(r"=\s*\|?\s*(?:\"[^\"]*\"|'[^']*')(?:\s*\|\s*(?:\"[^\"]*\"|'[^']*'))+"), "state").when(word != "const", "type")
    got = lines.where(F.col("text").rlike(rx)).select("file", "line", kind.alias("kind"), F.regexp_extract("text", rx, 3).alias("name"), (F.regexp_extract("text", rx, 1) != "").alias("exported"), F.regexp_replace(F.trim(F.regexp_replace("text", r"\s*\{?\s*$", "")), r"\s+", " ").alias("signature"), F.col("text"))
    variants = F.when(F.col("kind") == "state", F.regexp_extract_all("text", F.lit(r"[\"']([^\"']*)[\"']"), F.lit(1)))
    return got.where("kind is not null").select("file", "line", "kind", "name", "exported", "signature", variants.alias("variants"))


def imports(lines: DataFrame) -> DataFrame:
    """(file, local, imported, spec) of named imports of relative modules."""
    rx = r"^import\s+(?:type\s+)?\{([^}]*)\}\s+from\s+['\"](\.[^'\"]*)['\"]"
    got = lines.where(F.col("text").rlike(rx)).select("file", F.regexp_extract("text", rx, 2).alias("spec"), F.explode(F.split(F.regexp_extract("text", rx, 1), ",")).alias("item"))
    name = F.trim("item")
    return got.where(name != "").select("file", F.regexp_extract(name, r"([\w$]+)$", 1).alias("local"), F.regexp_extract(name, r"^([\w$]+)", 1).alias("imported"), "spec")


def resolved_modules(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(file, path) of what an import may mean against (file) that exist: the first of path.ts, path.tsx,
    path/index.ts, path/index.tsx, path."""
    options = F.array(*(F.struct(F.lit(i).alias("rank"), F.concat("path", F.lit(s)).alias("target")) for i, s in enumerate((".ts", ".tsx", "/index.ts", "/index.tsx", ""))))
    tried = wanted.select("file", "path", F.explode(options).alias("o")).select("file", "path", "o.*")
    hit = tried.join(files.select(F.col("file").alias("target")).distinct(), "target")
    return hit.groupBy("file", "path").agg(F.min_by("target", "rank").alias("target"))


def cross_file_calls(calls: DataFrame, imported: DataFrame, exports: DataFrame) -> DataFrame:
    """(caller_file, caller, local) calls by (file, local, imported, target) imports (the first of a name counts, by
    its position) to exported (file, name) declarations."""
    first = imported.groupBy("file", "local").agg(F.min_by(F.struct("imported", "target"), "position").alias("i"))
    hit = calls.join(first, (calls["caller_file"] == first["file"]) & (calls["local"] == first["local"]))
    hit = hit.select("caller_file", "caller", F.col("i.target").alias("file"), F.col("i.imported").alias("name"))
    return hit.join(exports.select("file", "name").distinct(), ["file", "name"])


def transitions(literals: DataFrame, states: DataFrame) -> DataFrame:
    """(file, from, to) pairs of literals in code against (file, state, variants): those that are both variants of
    one state, and differ."""
    hit = literals.where(F.col("from") != F.col("to")).join(states, "file")
    return hit.where(F.array_contains("variants", F.col("from")) & F.array_contains("variants", F.col("to"))).select("file", "state", "from", "to")


def grep(lines: DataFrame, pattern: Column | str, key: str = "file", before: int = 0, after: int = 0) -> DataFrame:
    """Lines that match, with so many lines around them; ``hit`` marks the match itself."""
    match = F.col("text").rlike(pattern) if isinstance(pattern, str) else pattern
    rows = lines.withColumn("hit", match)
    if not before and not after:
        return rows.where("hit")
    w = W.partitionBy(key).orderBy("line").rowsBetween(-after, before)
    return rows.withColumn("near", F.max(F.col("hit").cast("int")).over(w)).where("near = 1").drop("near")


def local_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls (file, caller, callee, receiver) within a file as edges (src, dst): a bare name means the file's function
    of that name, ``this.x`` within a member of a class that class' ``x``. Calls of oneself are dropped; each call
    site is a row. Of several functions of one name the first counts."""
    functions = nodes.where("kind = 'function'").groupBy("file", "name").agg(F.min("node_id").alias("id"))
    member = F.concat_ws(".", F.substring_index("caller", ".", 1), "callee")
    meant = F.when(F.col("receiver").isNull(), F.col("callee")).when((F.col("receiver") == "this") & F.contains("caller", F.lit(".")), member)
    src, dst = (functions.select("file", F.col("name").alias(c), F.col("id").alias(i)) for c, i in (("caller", "src"), ("meant", "dst")))
    return calls.withColumn("meant", meant).join(src, ["file", "caller"]).join(dst, ["file", "meant"]).where("src <> dst").select("src", "dst")


def replaced_calls(edges: DataFrame, answers: DataFrame, runs: DataFrame, key: str = "analysis") -> DataFrame:
    """Edges (key, src, dst, kind) with the calls of each analysis replaced by the distinct answers (key, src, dst) of its
    language server, where ``runs`` (key, ok) says that the server ran: then all old calls go, even if no answer came,
    and answers that a function calls itself do not count. Where it failed, or is not listed, the old calls stay."""
    ran = runs.where("ok").select(key).distinct()
    kept = edges.where("kind <> 'calls'").unionByName(edges.where("kind = 'calls'").join(ran, key, "left_anti").select(*edges.columns))
    new = answers.where("src <> dst").join(ran, key, "left_semi").select(key, "src", "dst").distinct().withColumn("kind", F.lit("calls"))
    return kept.select(key, "src", "dst", "kind").unionByName(new)


def call_targets(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Answers (file, name) of a language server with the first function of that file whose last part is the name."""
    first = nodes.where("kind = 'function'").groupBy("file", F.substring_index("name", ".", -1).alias("name")).agg(F.min("node_id").alias("node_id"))
    return answers.join(first, ["file", "name"])


def transition_literals(files: DataFrame) -> DataFrame:
    """(file, from, to): ``if (x === "a") … return "b"`` or ``x = "b"`` in its block (see ``blocks.transition_literals``)."""
    from . import blocks

    return blocks.transition_literals(files).select("file", "from", "to")


def samples(paths: DataFrame, meta: DataFrame) -> DataFrame:
    """Sample folders ``pr-…/base/…`` and ``pr-…/head/…`` among (path): (id, title, description, has_intent) of those
    that have both sides; a title or description in ``meta`` (id, title, description) wins over the one of the name."""
    from ..functions.text import slug_title

    part = F.split("path", "/")
    by = paths.select(part[0].alias("id"), part[1].alias("side")).where(F.col("id").startswith("pr-")).groupBy("id")
    by = by.agg(F.bool_or(F.col("side") == "base").alias("b"), F.bool_or(F.col("side") == "head").alias("h"), F.bool_or(F.col("side") == "intent.json").alias("has_intent")).where("b and h")
    own = meta.select("id", F.col("title").alias("t"), F.col("description").alias("d"))
    told = F.coalesce("d", F.concat(F.lit("Sample PR from "), F.col("id"), F.lit(".")))
    return by.join(own, "id", "left").select("id", F.coalesce("t", slug_title(F.col("id"))).alias("title"), told.alias("description"), "has_intent")


def matching(files: DataFrame, glob: str, file: str = "file") -> DataFrame:
    """Files of a glob: ``*`` and ``?`` within a folder, ``**/`` over any number of them, ``{a,b}`` either."""
    rx = "".join({"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c, re.escape(c)) if c != "\0" else "(?:.*/)?" for c in glob.replace("**/", "\0"))
    return files.where(F.col(file).rlike(f"^(?:{rx})$"))


def grep_files(lines: DataFrame, pattern: str, key: str = "file", head: int | None = None, offset: int = 0) -> DataFrame:
    """The files that match, in order; from ``offset`` on, ``head`` of them if it is given."""
    found = grep(lines, pattern, key).select(key).distinct()
    if head is None and not offset:
        return found
    found = found.orderBy(key).offset(offset)
    return found if head is None else found.limit(head)


def read_lines(lines: DataFrame, first: int = 1, most: int | None = None) -> DataFrame:
    """Lines from ``first`` on (counted from 1), ``most`` of each file if it is given."""
    return lines.where(F.col("line") >= first) if most is None else lines.where(F.col("line").between(first, first + most - 1))


def grep_counts(lines: DataFrame, pattern: str, key: str = "file") -> DataFrame:
    return grep(lines, pattern, key).groupBy(key).agg(F.count("*").alias("matches"))


#: Endings of some kinds of files (fixed values).
FILE_TYPES = {
    "ts": ("ts", "tsx", "cts", "mts"), "js": ("js", "jsx", "cjs", "mjs", "vue"), "rust": ("rs",), "py": ("py", "pyi"), "json": ("json",), "md": ("md", "markdown", "mdown", "mkdn"),
    "yaml": ("yaml", "yml"), "toml": ("toml",), "html": ("html", "htm", "ejs"), "css": ("css", "scss"), "txt": ("txt",),
}


def scoped(files: DataFrame, path: str | None = None, glob: str | None = None, kind: str | None = None, file: str = "file") -> DataFrame:
    """The rows of files below a path (or of the file itself), of a glob, of a kind of file; a glob without a slash is one
    of names, at any depth."""
    out, of = files, F.col(file)
    if path:
        below = path.strip("/")
        out = out if below in ("", ".") else out.where((of == below) | of.startswith(below + "/"))
    if glob:
        out = matching(out, glob if "/" in glob else "**/" + glob, file)
    if kind:
        out = out.where(F.lower(of).rlike(r"\.(?:" + "|".join(FILE_TYPES[kind]) + ")$"))
    return out


def any_case(pattern: str) -> str:
    return f"(?i){pattern}"


def grep_multiline(files: DataFrame, pattern: str, key: str = "file", text: str = "content") -> DataFrame:
    """(key, line, last_line, text) of matches that may span lines, a dot standing for any character: the lines on which a
    match begins and ends, and what it matched."""
    from . import blocks

    found = blocks.tokens(files, f"(?s:{pattern})", (key,), text)
    breaks = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit("\n"))
    before = F.sum(breaks(F.col("token")) + breaks(F.col("tail"))).over(W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    at = found.withColumn("line", F.coalesce(before, F.lit(0)) + 1).where("i > 0")
    return at.select(key, "line", (F.col("line") + breaks(F.col("token"))).alias("last_line"), F.col("token").alias("text"))


def glob_page(files: DataFrame, glob: str, path: str | None = None, head: int | None = None, offset: int = 0) -> DataFrame:
    """The files of a glob below a path, in order; from ``offset`` on, ``head`` of them if it is given."""
    found = matching(scoped(files, path).select("file"), glob).distinct().orderBy("file").offset(offset)
    return found if head is None else found.limit(head)
