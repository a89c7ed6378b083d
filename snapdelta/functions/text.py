"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments that mark tests and examples.
TEST_SEGMENTS = ("tests", "__tests__", "spec")
EXAMPLE_SEGMENTS = ("examples", "example", "demos", "demo")
# What an error message may say (alternatives of substrings that must all be there), in the order in
# which it is tried, the title that this gets, and the hint for the user.
ERROR_RULES = (
    ((("401",), ("sign in",)), "Not signed in", "Sign in with GitHub so we can read the PR and clone its refs."),
    ((("403",),), "GitHub denied access", "The stored token may be expired. Sign out + back in, then retry."),
    ((("404",), ("not a pr url",)), "PR not found", "Double-check the URL — this worked in my browser: https://github.com/owner/repo/pull/123."),
    ((("rate", "limit"),), "GitHub rate-limited us", "Wait a minute and retry — the client-hour budget is shared across signed-in sessions."),
    ((("git ", "fatal"), ("git ", "failed")), "Clone failed", "The repo or SHA isn't reachable with the current scopes. Public repos only for now."),
    ((("invalid url",), ("not a github",), ("not a pr url",)), "Invalid PR URL", "Expected `https://github.com/<owner>/<repo>/pull/<n>`."),
    ((("networkerror",), ("failed to fetch",)), "Can't reach the backend", "The server isn't responding on :8787. Check it's running."),
)
OTHER_ERROR = "Something went wrong"


def qualified_name(kind: Column, name: Column, method: Column, path: Column, variant: str = "full") -> Column:
    """What a declaration is called: an endpoint by method and path, a file by its path, others by name. ``no-files``
    gives files no name; ``paths`` calls an endpoint by its path alone."""
    endpoint = path if variant == "paths" else F.concat_ws(" ", method, path)
    return F.when(kind == "api-endpoint", endpoint).when(kind == "file", F.lit(None) if variant == "no-files" else path).otherwise(name)


def basename(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\]*$", 0))


def _segment(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), r"[/\\]"), F.array(*map(F.lit, names)))


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(test|spec)\.") | _segment(path, TEST_SEGMENTS)


def is_example_path(path: Column) -> Column:
    return _segment(path, EXAMPLE_SEGMENTS)


def resolved_path(path: Column) -> Column:
    """``a/./b/../c`` without its dots; null where it would leave the root, or is absolute or has a drive."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(acc, x):
        up = x == ".."
        return F.struct(F.when(up, F.slice(acc["p"], 1, F.greatest(F.size(acc["p"]) - 1, F.lit(0)))).otherwise(F.concat(acc["p"], F.array(x))).alias("p"), (acc["ok"] & ~(up & (F.size(acc["p"]) == 0))).alias("ok"))

    inside = F.aggregate(parts, start, step)
    bad = path.startswith("/") | path.startswith("\\") | F.contains(path, F.lit(":"))
    return F.when(~bad & inside["ok"], F.array_join(inside["p"], "/"))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def preview(text: Column, most: int = 80, kept: int = 77) -> Column:
    """A trimmed text, or if that is longer than ``most`` its beginning and an ellipsis."""
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(kept)), F.lit("…"))).otherwise(t)


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based character offset."""
    before = F.left(text, offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def utf16_length(text: Column) -> Column:
    """Code units in UTF-16: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def position_of(text: Column, offset: Column) -> Column:
    """(line, col), both from 1, the column in UTF-16, of a 0-based character offset; (1, 1) beyond the end."""
    inside = (offset >= 0) & (offset <= F.length(text))
    col = utf16_length(F.substring_index(F.left(text, offset), "\n", -1)) + 1
    one = F.lit(1)
    return F.struct(F.when(inside, line_of(text, offset)).otherwise(one).alias("line"), F.when(inside, col).otherwise(one).alias("col"))


def name_position(text: Column, start: Column, end: Column, name: Column) -> Column:
    """(line, col), both from 0, of the first ``name`` within the characters start to end; null if it isn't there."""
    at = F.instr(F.substr(text, start + 1, end - start), name)
    where = position_of(text, start + at - 1)
    return F.when(at > 0, F.struct((where["line"] - 1).alias("line"), (where["col"] - 1).alias("col")))


def last_segment(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def highlight_length(name: Column) -> Column:
    return utf16_length(last_segment(name))


def is_path_id(sha: Column) -> Column:
    """Whether what stands for a commit is a path: a drive letter, a slash or a network share."""
    return sha.rlike(r"^[a-zA-Z]:") | sha.startswith("/") | sha.startswith("\\\\") | sha.startswith("\\?\\")


def short_id(sha: Column) -> Column:
    """The last part of a path or commit, cut after twelve characters."""
    part = F.substring_index(F.replace(sha, F.lit("\\"), F.lit("/")), "/", -1)
    return F.when(F.length(part) > 12, F.concat(F.left(part, F.lit(12)), F.lit("…"))).otherwise(part)


def flow_label(name: Column) -> Column:
    """A flow's name without the wrapper of structural ones, its first letter large."""
    inner = F.nullif(F.regexp_extract(name, r"^<structural:\s*(.+?)>$", 1), F.lit(""))
    raw = F.coalesce(inner, name)
    return F.when(raw.rlike("^[a-z]"), F.concat(F.upper(F.left(raw, F.lit(1))), F.substring(raw, 2, 1 << 20))).otherwise(raw)


def row_label(repo: Column, sha: Column) -> Column:
    """``owner/name`` with or without a number, as it is; anything else is local, with eight characters of the commit."""
    r = F.trim(repo)
    return F.when(r.rlike(r"^[\w.-]+/[\w.-]+(\s+#\d+)?$"), r).otherwise(F.concat(F.lit("local · "), F.left(sha, F.lit(8))))


def pair_slug(base: Column, head: Column) -> Column:
    """``x-base-y`` and ``x-head-y`` to ``x #y`` (``x`` if nothing follows); null if the pair isn't of that form."""
    places = F.filter(F.sequence(F.lit(1), F.length(base)), lambda i: (F.substr(base, i, F.lit(4)) == "base") & (head == F.concat(F.left(base, i - 1), F.lit("head"), F.substr(base, i + 4))))
    at = F.try_element_at(F.when(F.length(base) > 0, places), F.lit(1))
    before = F.regexp_replace(F.left(base, at - 1), r"[-_]+$", "")
    after = F.regexp_replace(F.substr(base, at + 4), r"^[-_]+", "")
    return F.when(before != "", F.when(after != "", F.concat(before, F.lit(" #"), after)).otherwise(before))


def without_comments(text: Column) -> Column:
    """JSON with line comments to JSON: ``//`` and what follows on the line goes, but not inside strings."""
    return F.regexp_replace(text, r'("(?:\\.|[^"\\])*(?:"|$))|//[^\n]*', "$1")


def canonical_tool(name: Column, prefix: str, older: tuple[str, ...] = ()) -> Column:
    """``prefix:x``, and ``old.x`` and ``old:x`` of older prefixes, as ``prefix.x``."""
    forms = [f"{prefix}:", *(f"{o}{c}" for o in older for c in ".:")]
    out = F.when(F.lit(False), name)
    for f in forms:
        out = out.when(name.startswith(f), F.concat(F.lit(f"{prefix}."), F.substring(name, len(f) + 1, 1 << 20)))
    return out.otherwise(name)


def error_envelope(code: Column, message: Column) -> Column:
    """(text, is_error) of a tool's answer: the code on a line of its own, then code and message as JSON."""
    body = F.to_json(F.struct(code.alias("code"), message.alias("message")))
    return F.struct(F.concat(F.lit("ERROR: "), code, F.lit("\n"), body).alias("text"), code.isNotNull().alias("is_error"))


def provider_model(setting: Column) -> Column:
    """``provider:model`` in its two parts; the model keeps further colons. Null without a colon or with an empty part."""
    rx = r"^([^:]+):(.+)$"
    ok = setting.rlike(rx)
    return F.struct(F.when(ok, F.lower(F.trim(F.regexp_extract(setting, rx, 1)))).alias("provider"), F.when(ok, F.trim(F.regexp_extract(setting, rx, 2))).alias("model"))


def stored_path(*parts: Column) -> Column:
    """A folder of the parts in turn, in each of which : / and \\ are two underscores."""
    return F.concat_ws("/", *(F.regexp_replace(p, r"[:/\\]", "__") for p in parts))


def intent_text(title: Column, url: Column, body: Column) -> Column:
    """Title, address and body of a pull request as one text; null if all are blank."""
    t, u, b = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, url, body))
    text = F.concat(F.when(t != "", F.concat(F.lit("# "), t, F.lit("\n\n"))).otherwise(""), F.when(u != "", F.concat(F.lit("<"), u, F.lit(">\n\n"))).otherwise(""), b)
    return F.when(F.trim(text) != "", text)


def intent_inputs(log: Column, readme: Column, changed: Column, most_log: int = 8000, lines: int = 40, files: int = 60) -> Column:
    """The prompt of commit messages (so many characters), the first lines of a readme, and changed files (so many,
    then how many more); parts that are missing are left out."""
    text = lambda c: F.coalesce(c, F.lit(""))
    head = F.array_join(F.slice(F.split(readme, "\n"), 1, lines), "\n")
    listed = F.array_join(F.transform(F.slice(changed, 1, files), lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))), "")
    more = F.when(F.size(changed) > files, F.concat(F.lit("  … ("), (F.size(changed) - files).cast("string"), F.lit(" more)\n"))).otherwise("")
    return F.concat(
        text(F.when(F.trim(log) != "", F.concat(F.lit("Commit messages between base and head:\n"), F.left(F.trim(log), F.lit(most_log)), F.lit("\n\n")))),
        text(F.when(readme.isNotNull(), F.concat(F.lit("README excerpt (for project vocabulary):\n"), head, F.lit("\n\n")))),
        text(F.when(F.size(changed) > 0, F.concat(F.lit("Changed files:\n"), listed, more))),
    )


def normalised_signature(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"\s+", " ")


def relative_time(ts: Column, now: Column) -> Column:
    """Seconds under a minute, minutes under an hour, hours under two days, else days; the future is 0s."""
    s = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(ts), F.lit(0))
    m = F.round(s / 60).cast("long")
    h = F.round(m / 60).cast("long")
    d = F.round(h / 24).cast("long")
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(s < 60, part(s, "s")).when(m < 60, part(m, "m")).when(h < 48, part(h, "h")).otherwise(part(d, "d"))


def error_title(message: Column) -> Column:
    """What an error message is called, and a hint (null if no rule holds): the first rule that holds decides."""
    low = F.lower(message)
    title, hint = F.when(message.isNull(), OTHER_ERROR), F.when(message.isNull(), F.lit(None).cast("string"))
    for options, name, advice in ERROR_RULES:
        holds = F.lit(False)
        for needles in options:
            every = F.lit(True)
            for needle in needles:
                every = every & F.contains(low, F.lit(needle))
            holds = holds | every
        title, hint = title.when(holds, name), hint.when(holds, advice)
    return F.struct(title.otherwise(OTHER_ERROR).alias("title"), hint.alias("hint"))


def slug_title(slug: Column) -> Column:
    """``pr-0001-add-retry`` to ``Add retry``."""
    words = F.regexp_replace(F.regexp_replace(slug, r"^pr-\d+-", ""), "-", " ")
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 1 << 20))


def pull_request(url: Column) -> Column:
    """owner, repo, number and an error code of a pull request's address."""
    rx = r"^https?://(?:www\.)?github\.com/([^/]+)/([^/]+)/pull/(\d+)(?:[/?#].*)?$"
    part = lambda i: F.nullif(F.regexp_extract(url, rx, i), F.lit(""))
    return F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).cast("int").alias("number"), F.when(~url.rlike(rx), "NOT_A_PULL_REQUEST").alias("error"))


def fence_free(text: Column) -> Column:
    """What a code fence holds, or the text."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*\n?|\n?```\s*$", ""))


def balanced_object(text: Column) -> Column:
    """The first balanced ``{...}`` of a text, strings and escapes respected; null if there is none.

    A fold over the characters after the first brace: depth, inside a string, after a backslash, end found."""
    at = F.instr(text, "{")
    chars = F.split(F.substr(text, at), "")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(a, c):
        quoted = F.when(a["escaped"], a["quoted"]).when(c == '"', ~a["quoted"]).otherwise(a["quoted"])
        depth = a["depth"] + F.when(~a["quoted"] & (c == "{"), 1).when(~a["quoted"] & (c == "}"), -1).otherwise(0)
        closed = (a["end"] == 0) & (depth == 0) & (a["depth"] == 1)
        return F.struct((a["i"] + 1).alias("i"), depth.alias("depth"), quoted.alias("quoted"), (a["quoted"] & ~a["escaped"] & (c == "\\")).alias("escaped"), F.when(closed, a["i"] + 1).otherwise(a["end"]).alias("end"))

    end = F.aggregate(chars, start, step)["end"]
    return F.when(at > 0, F.when(end > 0, F.substr(text, at, end)))


def repaired_arguments(raw: Column) -> Column:
    """Tool arguments as a JSON object text: an object stays, a string or one-element list gives the object in
    it, HTML escapes are undone, ``k=v`` pairs become fields; else ``{}``."""
    plain = raw
    for mark, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(mark), F.lit(char))
    inner = F.replace(F.regexp_replace(F.trim(plain), r'^\[?\s*"|"\s*\]?$', ""), F.lit('\\"'), F.lit('"'))
    as_object = lambda x: F.when(F.trim(x).startswith("{") & F.try_parse_json(F.trim(x)).isNotNull(), F.trim(x))
    pairs = F.filter(F.split(raw, r"[,\s]+"), lambda p: p.rlike(r"^[A-Za-z_]\w*=.+$"))
    from_pairs = F.when(F.size(pairs) > 0, F.to_json(F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)), F.regexp_replace(p, "^[^=]*=", ""))))))
    return F.coalesce(as_object(raw), as_object(plain), as_object(inner), as_object(balanced_object(plain)), from_pairs, F.lit("{}"))


def inline_calls(text: Column) -> Column:
    """Complete ``<tool_call>`` blocks: an array of (name, arguments)."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    keys = lambda b: F.regexp_extract_all(b, F.lit(r"(?s)<arg_key>(.*?)</arg_key>"), F.lit(1))
    values = lambda b: F.regexp_extract_all(b, F.lit(r"(?s)<arg_value>(.*?)</arg_value>"), F.lit(1))
    return F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, r"^([^<]*)", 1)).alias("name"), F.map_from_arrays(F.transform(keys(b), lambda x: F.trim(x)), F.transform(values(b), lambda x: F.trim(x))).alias("arguments")))


def is_file_like(x: Column) -> Column:
    return F.contains(x, F.lit("/")) | x.rlike(r"\.(ts|tsx|js|jsx|rs)$")


def _said(x: Column) -> Column:
    return F.coalesce(x.rlike(r"\S"), F.lit(False))


def clean_members(entities: Column, most: int = 10) -> Column:
    """Entities without blanks and file-like ones, ``most`` at most."""
    return F.slice(F.filter(entities, lambda e: _said(e) & ~is_file_like(e)), 1, most)


def clean_groups(groups: Column, most: int = 10) -> Column:
    """Groups (label, sample_entities) with a label, ``most`` at most, their samples without blanks and file-like ones."""
    own = F.transform(groups, lambda g: g.withField("sample_entities", F.filter(g["sample_entities"], lambda e: _said(e) & ~is_file_like(e))))
    return F.slice(F.filter(own, lambda g: _said(g["label"])), 1, most)


def clean_edges(edges: Column) -> Column:
    """Edges (from, to) of which neither end is blank or file-like."""
    return F.filter(edges, lambda e: _said(e["from"]) & _said(e["to"]) & ~is_file_like(e["from"]) & ~is_file_like(e["to"]))


def clean_shapes(shapes: Column) -> Column:
    return F.filter(shapes, lambda x: _said(x["kind"]))


def doc_params(comment: Column) -> Column:
    """Names after @param, in order: a type in braces is passed over, brackets, defaults and question marks are left out."""
    lines = F.transform(F.split(comment, r"\r?\n"), lambda x: F.regexp_replace(x, r"^[/*\s]+", ""))
    rest = F.transform(F.filter(lines, lambda x: x.startswith("@param")), lambda x: F.regexp_replace(x, r"^@param\s*", ""))
    named = F.transform(F.filter(rest, lambda x: ~x.startswith("{") | F.contains(x, F.lit("}"))), lambda x: F.regexp_extract(F.regexp_replace(x, r"^\{[^}]*\}\s*", ""), r"^([^\s:-]*)", 1))
    bare = F.transform(named, lambda x: F.substring_index(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\?+$", ""), r"^\[+", ""), r"\]+$", ""), "=", 1))
    return F.filter(bare, lambda x: x != "")
