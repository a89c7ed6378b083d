"""Captured tool reports as tables: coverage, diagnostics, test failures, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is kept of a captured output.
OUTPUT_BYTES = 65536


def lcov(reports: DataFrame, text_col: str = "text") -> DataFrame:
    """(file, permille) of LCOV texts, other columns kept: records without lines are skipped, the last record of
    a file wins."""
    keys = [c for c in reports.columns if c != text_col]
    records = reports.select(*keys, F.posexplode(F.split(text_col, "end_of_record")).alias("pos", "r"))
    number = lambda tag: F.regexp_extract("r", rf"(?m)^{tag}:(\d+)", 1)
    got = records.select(*keys, "pos", F.trim(F.regexp_extract("r", r"(?m)^SF:(.*)$", 1)).alias("file"), number("LF").alias("lf"), number("LH").alias("lh")).where("file <> '' and lf <> '' and lh <> '' and cast(lf as long) > 0")
    got = got.withColumn("permille", F.expr("cast(lh as long) * 1000 div cast(lf as long)"))
    return got.groupBy(*keys, "file").agg(F.max_by("permille", "pos").alias("permille"))


def coverage_json(reports: DataFrame, text_col: str = "text") -> DataFrame:
    """(file, permille) of coverage summaries: every key but total; a report with an entry without lines.pct
    counts as unreadable and gives no rows."""
    keys = [c for c in reports.columns if c != text_col]
    entries = F.from_json(text_col, "map<string,struct<lines:struct<pct:double>>>")
    parsed = reports.select(*keys, F.map_entries(F.map_filter(entries, lambda k, v: k != "total")).alias("e"))
    whole = parsed.where(~F.exists("e", lambda x: x["value"]["lines"]["pct"].isNull()))
    return whole.select(*keys, F.explode("e").alias("x")).select(*keys, F.col("x.key").alias("file"), F.round(F.col("x.value.lines.pct") * 10).cast("long").alias("permille"))


def coverage_files(present: DataFrame, named: str | None = None) -> DataFrame:
    """(root, side, path) of files that exist to the report each root reads on each side: the named one, else LCOV, else
    the summary; roots without a report on both sides are left out."""
    options = [p for p in (named, "coverage/lcov.info", "coverage/coverage-summary.json") if p]
    rank = F.array_position(F.array(*map(F.lit, options)), F.col("path"))
    best = present.withColumn("_r", rank).where("_r > 0").groupBy("root", "side").agg(F.min_by("path", "_r").alias("path"))
    both = best.groupBy("root").agg(F.countDistinct("side").alias("n")).where("n = 2").select("root")
    return best.join(both, "root", "left_semi")


def compiler_lines(lines: DataFrame, text_col: str = "line") -> DataFrame:
    """``file(line,col): error|warning CODE: message`` as columns; other lines are dropped."""
    rx = r"^(.+?)\((\d+),(\d+)\): (error|warning) ([A-Za-z]+\d+): (.*)$"
    keys = [c for c in lines.columns if c != text_col]
    part = lambda i: F.regexp_extract(text_col, rx, i)
    return lines.where(F.col(text_col).rlike(rx)).select(*keys, F.regexp_replace(part(1), r"\\", "/").alias("file"), part(2).cast("int").alias("at_line"), part(3).cast("int").alias("at_col"), part(4).alias("severity"), part(5).alias("code"), part(6).alias("message"))


def failing_tests(lines: DataFrame, text_col: str = "line") -> DataFrame:
    """Distinct files of failing tests in the output of common runners, colours stripped."""
    keys = [c for c in lines.columns if c != text_col]
    plain = F.trim(F.regexp_replace(text_col, "\x1b\\[[0-9;]*m", ""))
    path = F.regexp_extract(plain, r"^(?:FAIL\s+|❯ |× )([^\s>(]+)", 1)
    return lines.select(*keys, path.alias("file")).where(F.col("file").rlike(r"\.(test|spec)\.")).distinct()


def kept_output(text: str):
    """(kept, truncated) of a captured output."""
    return F.struct(F.left(text, F.lit(OUTPUT_BYTES)).alias("kept"), (F.length(text) > OUTPUT_BYTES).alias("truncated"))


def workspace_globs(manifests: DataFrame) -> DataFrame:
    """(root, file, content) of workspace manifests to (root, glob), without a slash at the end: the packages of
    pnpm-workspace.yaml (as a list of lines or in brackets), the workspaces of package.json (a list, or an object's
    packages), and the paths that tsconfig.json refers to (comments allowed)."""
    from ..functions.text import without_comments

    name, text = F.substring_index("file", "/", -1), F.col("content")
    listed = F.regexp_extract(text, r"(?m)^packages:[ \t]*(?:#[^\n]*)?\n((?:[ \t]*(?:-[^\n]*|#[^\n]*)?(?:\n|$))*)", 1)
    in_line = F.regexp_extract(text, r"(?m)^packages:[ \t]*\[([^\]]*)\]", 1)
    items = lambda c, rx: F.transform(F.regexp_extract_all(c, F.lit(rx), F.lit(1)), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s#.*$", "")), r"^['\"]|['\"]$", ""))
    yaml = F.concat(items(listed, r"(?m)^[ \t]*-[ \t]+([^\n]*)$"), items(in_line, r"([^,\s][^,]*)"))
    strings = lambda path, shape: F.from_json(F.get_json_object(text, path), shape)
    workspaces = F.coalesce(strings("$.workspaces", "array<string>"), strings("$.workspaces.packages", "array<string>"))
    paths = F.transform(F.from_json(F.get_json_object(without_comments(text), "$.references"), "array<struct<path: string>>"), lambda r: r["path"])
    globs = F.when(name == "pnpm-workspace.yaml", yaml).when(name == "package.json", workspaces).when(name == "tsconfig.json", paths)
    found = manifests.select("root", F.explode(globs).alias("glob")).where("glob is not null")
    return found.select("root", F.regexp_replace(F.regexp_replace("glob", r"^\./", ""), "/+$", "").alias("glob")).where("glob <> ''").distinct()


def glob_pattern(glob: Column) -> Column:
    """A glob of folders as a pattern: ``*`` and ``?`` within a name, ``**`` over any number of them, ``{a,b}`` either."""
    quoted = F.regexp_replace(glob, r"([.+()|^$\\\[\]])", r"\\$1")
    either = F.replace(F.translate(F.regexp_replace(quoted, r"\{([^}]*)\}", "(?:\u0003$1)"), ",", "|"), F.lit("\u0003"), F.lit(""))
    some = F.replace(F.replace(F.replace(either, F.lit("**/"), F.lit("\u0001")), F.lit("**"), F.lit("\u0002")), F.lit("*"), F.lit("[^/]*"))
    some = F.regexp_replace(some, r"(?<!\()\?", "[^/]")
    return F.concat(F.lit("^"), F.replace(F.replace(some, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*")), F.lit("$"))


def workspace_folders(globs: DataFrame, files: DataFrame) -> DataFrame:
    """(root, folder): the folders of (root, file) that the globs of a workspace mean, at the depth of the glob.

    A glob's literal beginning, the names before its first wildcard, and its depth are a key: folders of that depth meet
    it by equality, under their first names, and only those are tried against its pattern."""
    parts = F.split("file", "/")
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    folder = files.select("root", F.explode(folders).alias("folder")).distinct().withColumn("depth", F.size(F.split("folder", "/")))
    names = F.split("glob", "/")
    wild = F.filter(F.transform(names, lambda x, i: F.when(x.rlike(r"[*?{\[]"), i)), lambda i: i.isNotNull())
    lead = F.when(F.size(wild) > 0, wild[0]).otherwise(F.size(names))
    g = globs.select("root", "glob", F.size(names).alias("depth"), lead.alias("k"), F.array_join(F.slice(names, 1, lead), "/").alias("lead"))
    wanted = g.select("root", "depth", "k").distinct()  # as many keys a folder as its workspace has kinds of globs
    met = folder.join(wanted, ["root", "depth"]).withColumn("lead", F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.col("k")), "/"))
    hit = met.join(g, ["root", "depth", "k", "lead"]).where(F.rlike("folder", glob_pattern(F.col("glob"))))
    return hit.select("root", "folder").distinct()


def workspace_packages(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(root, folder, package): the packages of workspaces from their manifests (root, file, content) and all files (root,
    file); a package is called by the name in its package.json, or by its folder."""
    folders = workspace_folders(workspace_globs(manifests), files)
    own = manifests.where(F.col("file").endswith("/package.json")).select("root", F.regexp_replace("file", "/package\\.json$", "").alias("folder"), F.get_json_object("content", "$.name").alias("name"))
    return folders.join(own.dropDuplicates(["root", "folder"]), ["root", "folder"], "left").select("root", "folder", F.coalesce("name", "folder").alias("package"))


def packages(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(file) with the package of the longest root (root, package) that it lies under: the file's own folders are
    listed and met by equality."""
    parts = F.split("file", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = files.select("file", F.explode(folders).alias("root")).join(roots, "root").groupBy("file").agg(F.max_by("package", F.length("root")).alias("package"))
    return files.join(hit, "file", "left")
