"""The typed deltas between two snapshots, and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diff import keyed_diff, last_by_key, renamed, row_delta, set_delta

#: Order in which the kinds of delta are listed.
KINDS = ("call", "state", "api", "lock", "data", "docs", "deletion")


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) whose ends are both nodes, with the file and name of each end."""
    s = nodes.select(F.col("node_id").alias("src"), F.col("file").alias("caller_file"), F.col("name").alias("caller_name"))
    t = nodes.select(F.col("node_id").alias("dst"), F.col("file").alias("callee_file"), F.col("name").alias("callee_name"))
    return edges.join(s, "src").join(t, "dst")


def call_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """Calls (rows of ``named_edges``) on one side only; each call site is a row."""
    return row_delta(base, head, ["caller_file", "caller_name", "callee_name"])


def state_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """(file, name, variants): variants added and removed."""
    return set_delta(base, head, ["file", "name"], "variants")


def api_delta(base: DataFrame, head: DataFrame, exports_base: DataFrame, exports_head: DataFrame) -> DataFrame:
    """Exported functions whose signature differs; the last of duplicates on a side counts."""

    def side(nodes: DataFrame, exports: DataFrame) -> DataFrame:
        own = nodes.where("kind = 'function'").join(exports, "node_id", "left_semi")
        return last_by_key(own.select("file", "name", "signature", "node_id"), ["file", "name"], "node_id")

    d = keyed_diff(side(base, exports_base), side(head, exports_head), ["file", "name"], ["signature"])
    return d.where("status <> 'unchanged'")


def needle_hits(files: DataFrame, needles: DataFrame) -> DataFrame:
    """(file, primitive) for each needle that the content holds. Needles are a small fixed list: one condition
    each, in one pass over the files."""
    pairs = [(r["primitive"], r["needle"]) for r in needles.collect()]
    found = F.filter(F.array(*(F.when(F.contains("content", F.lit(n)), F.lit(p)) for p, n in pairs)), lambda x: x.isNotNull())
    return files.select("file", F.explode(F.array_distinct(found)).alias("primitive"))


def lock_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """Primitives of a file on one side only, as before and after."""
    d = keyed_diff(base.distinct(), head.distinct(), ["file", "primitive"], [])
    on = F.col("primitive")
    return d.where("status in ('added', 'removed')").select("file", "primitive", F.when(F.col("status") == "removed", on).alias("before"), F.when(F.col("status") == "added", on).alias("after"))


def data_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """(file, type_name, fields): fields added and removed, one of each being a rename."""
    return renamed(set_delta(base, head, ["file", "type_name"], "fields"))


def described(parts: dict[str, DataFrame]) -> DataFrame:
    """The deltas of each kind in one form: (kind, kind_rank, hunk_id, file, name, callee, added, removed, renamed, note).

    All calls that changed are one hunk, of a row for each changed call; of the other kinds each row is a hunk.
    ``added``, ``removed`` and ``renamed`` count what a row says was; ``note`` is the kind of drift of docs, and
    whether a deleted declaration was exported."""
    zero, one, none = F.lit(0), F.lit(1), F.lit(None).cast("string")
    yes = lambda c: c.cast("int")
    size = lambda c: F.size(c)
    form = {
        "call": ("caller_file", "caller_name", F.col("callee_name"), lambda c: yes(c("change") == "added"), lambda c: yes(c("change") == "removed"), lambda c: zero, none),
        "state": ("file", "name", none, lambda c: size("added"), lambda c: size("removed"), lambda c: zero, none),
        "api": ("file", "name", none, lambda c: yes(c("after_signature").isNotNull()), lambda c: yes(c("before_signature").isNotNull()), lambda c: zero, none),
        "lock": ("file", "primitive", none, lambda c: yes(c("after").isNotNull()), lambda c: yes(c("before").isNotNull()), lambda c: zero, none),
        "data": ("file", "type_name", none, lambda c: size("added"), lambda c: size("removed"), lambda c: yes(c("renamed_to").isNotNull()), none),
        "docs": ("file", "fn", none, lambda c: zero, lambda c: zero, lambda c: zero, F.col("drift")),
        "deletion": ("file", "name", none, lambda c: zero, lambda c: one, lambda c: zero, F.when(F.col("was_exported"), "exported ").otherwise("")),
    }
    out = {}
    for kind, df in parts.items():
        file, name, callee, added, removed, renamed_, note = form[kind]
        hunk = F.lit(kind) if kind == "call" else F.concat_ws("|", F.lit(kind), file, name)
        out[kind] = df.select(hunk.alias("hunk_id"), F.col(file).alias("file"), F.col(name).alias("name"), callee.alias("callee"), added(F.col).alias("added"), removed(F.col).alias("removed"), renamed_(F.col).alias("renamed"), note.alias("note"))
    return union_of_kinds(out)


def summaries(hunks: DataFrame) -> DataFrame:
    """``described`` rows to one row for each hunk: (hunk_id, kind, side, summary). The side is added or removed if all
    that a hunk says is of that kind, else both."""
    by = hunks.groupBy("hunk_id", "kind").agg(*(F.sum(c).alias(c) for c in ("added", "removed", "renamed")), *(F.first(c).alias(c) for c in ("file", "name", "note")))
    side = F.when(F.col("kind") == "docs", "both").when((F.col("added") > 0) & (F.col("removed") == 0), "added").when((F.col("added") == 0) & (F.col("removed") > 0), "removed").otherwise("both")
    text = {
        "call": F.format_string("call edges: +%d / -%d", "added", "removed"),
        "state": F.format_string("state `%s`: +%d / -%d variant(s)", "name", "added", "removed"),
        "api": F.format_string("api `%s` signature changed", "name"),
        "lock": F.format_string("lock `%s` in %s", "name", "file"),
        "data": F.format_string("data `%s` in %s: +%d/-%d fields, %d renamed", "name", "file", "added", "removed", "renamed"),
        "docs": F.format_string("docs drift (%s) on `%s` in %s", "note", "name", "file"),
        "deletion": F.format_string("deletion: %s`%s` in %s", "note", "name", "file"),
    }
    summary = F.when(F.lit(False), "")
    for kind, said in text.items():
        summary = summary.when(F.col("kind") == kind, said)
    return by.select("hunk_id", "kind", side.alias("side"), summary.alias("summary"))


def docs_drift(docs: DataFrame) -> DataFrame:
    """(file, fn, doc_params, sig_params): where they disagree; nothing is said if one is empty."""
    drift = F.when(F.size("doc_params") != F.size("sig_params"), "param-count").when(F.array_sort(F.array_distinct("doc_params")) != F.array_sort(F.array_distinct("sig_params")), "param-names")
    return docs.where("size(doc_params) > 0 and size(sig_params) > 0").withColumn("drift", drift).where("drift is not null").select("file", "fn", "drift")


def deletions(base: DataFrame, head: DataFrame) -> DataFrame:
    """Base declarations whose name is nowhere in head, once for each (file, name)."""
    gone = base.where("kind in ('function', 'type', 'state')").join(head.select("name").distinct(), "name", "left_anti")
    exported = F.max(F.col("signature").startswith("export ") | F.col("signature").startswith("pub "))
    return gone.groupBy("file", "name").agg(exported.alias("was_exported"))


def union_of_kinds(parts: dict[str, DataFrame]) -> DataFrame:
    """All deltas, by kind; columns that a kind lacks are null."""
    out = None
    for kind in KINDS:
        if kind in parts:
            one = parts[kind].withColumn("kind", F.lit(kind)).withColumn("kind_rank", F.lit(KINDS.index(kind)))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
