"""Operators on small literal inputs, and properties that must hold."""

import re

from pyspark.sql import functions as F

from snapdelta.functions import text as tx
from snapdelta.operators import cost, diff, evidence, flows, graph, hunks, resolve, review, state
from snapdelta.sources import reports, tree
from snapdelta.streaming import progress


def pairs(df):
    return {tuple(r) for r in df.collect()}


def nodes(spark, rows):
    return spark.createDataFrame(rows, "node_id long, file string, name string, signature string, kind string")


BASE = [(1, "q.ts", "enqueue", "f(a)", "function"), (2, "q.ts", "send", "f()", "function"), (3, "q.ts", "gone", "f()", "function")]
HEAD = [(1, "q.ts", "enqueue", "f(a, b)", "function"), (2, "q.ts", "retry", "f()", "function"), (3, "q.ts", "send", "f()", "function")]


def test_call_delta_of_an_added_step(spark):
    b, h = nodes(spark, BASE), nodes(spark, HEAD)
    eb, eh = spark.createDataFrame([(1, 2)], "src long, dst long"), spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    d = hunks.call_delta(hunks.named_edges(eb, b), hunks.named_edges(eh, h))
    assert pairs(d.select("change", "caller_name", "callee_name")) == {("added", "enqueue", "retry"), ("added", "retry", "send"), ("removed", "enqueue", "send")}
    swapped = hunks.call_delta(hunks.named_edges(eh, h), hunks.named_edges(eb, b))
    assert {(c, x) for c, x, _ in pairs(swapped.select("change", "caller_name", "callee_name"))} == {("removed", "enqueue"), ("removed", "retry"), ("added", "enqueue")}
    assert hunks.call_delta(hunks.named_edges(eb, b), hunks.named_edges(eb, b)).count() == 0


def test_state_and_data_deltas(spark):
    b = spark.createDataFrame([("m.ts", "S", ["idle", "running"]), ("m.ts", "Gone", ["x"])], "file string, name string, variants array<string>")
    h = spark.createDataFrame([("m.ts", "S", ["idle", "running", "retrying", "failed"])], "file string, name string, variants array<string>")
    got = {r.name: (r.added, r.removed) for r in hunks.state_delta(b, h).collect()}
    assert got == {"S": (["retrying", "failed"], []), "Gone": ([], ["x"])}
    db = spark.createDataFrame([("j", "A", ["id"]), ("j", "B", ["id", "x"])], "file string, type_name string, fields array<string>")
    dh = spark.createDataFrame([("j", "A", ["jobId", "retries", "deadline"]), ("j", "B", ["id", "y"])], "file string, type_name string, fields array<string>")
    got = {r.type_name: (r.added, r.removed, r.renamed_from, r.renamed_to) for r in hunks.data_delta(db, dh).collect()}
    assert got == {"A": (["deadline", "jobId", "retries"], ["id"], None, None), "B": ([], [], "x", "y")}


def test_api_delta_and_deletion(spark):
    b, h = nodes(spark, BASE + [(9, "q.ts", "send", "f(old)", "function")]), nodes(spark, HEAD)
    every = lambda df: df.select("node_id").distinct()
    got = {r.name: (r.before_signature, r.after_signature, r.status) for r in hunks.api_delta(b, h, every(b), every(h)).collect()}
    assert got == {"enqueue": ("f(a)", "f(a, b)", "changed"), "retry": (None, "f()", "added"), "gone": ("f()", None, "removed"), "send": ("f(old)", "f()", "changed")}
    assert pairs(hunks.deletions(b, h)) == {("q.ts", "gone", False)}
    drift = spark.createDataFrame([("f", "a", ["x"], ["x", "y"]), ("f", "b", ["x", "z"], ["x", "y"]), ("f", "c", ["x"], ["x"]), ("f", "d", [], ["x"])], "file string, fn string, doc_params array<string>, sig_params array<string>")
    assert {(r.fn, r.drift) for r in hunks.docs_drift(drift).collect()} == {("a", "param-count"), ("b", "param-names")}


def test_lock_delta(spark):
    files = lambda text: spark.createDataFrame([("queue.ts", text)], "file string, content string")
    needles = spark.createDataFrame([("Mutex", "new Mutex("), ("Atomics", "Atomics.")], "primitive string, needle string")
    d = hunks.lock_delta(hunks.needle_hits(files("class Q {}"), needles), hunks.needle_hits(files("this.m = new Mutex()"), needles))
    assert pairs(d) == {("queue.ts", "Mutex", None, "Mutex")}


def test_row_classes_keep_duplicates(spark):
    b = spark.createDataFrame([("a", 1), ("b", 2)], "file string, line long")
    h = spark.createDataFrame([("a", 1), ("c", 3), ("c", 3)], "file string, line long")
    got = sorted((r["class"], r.file) for r in diff.row_classes(b, h, ["file", "line"]).collect())
    assert got == [("new", "c"), ("new", "c"), ("persistent", "a"), ("resolved", "b")]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 1)], "src long, dst long")
    seed = spark.createDataFrame([(1,)], "node long")
    assert pairs(graph.neighbours(e, seed, 2)) == {(1, 0), (2, 1), (9, 1), (3, 2)}
    assert pairs(graph.induced(e, seed.union(spark.createDataFrame([(2,)], "node long")))) == {(1, 2)}
    s = spark.createDataFrame([("f", 1), ("f", 2)], "flow string, node long")
    assert pairs(graph.propagation(e, s).select("src", "dst")) == {(2, 3), (3, 4), (9, 1)}
    assert pairs(graph.propagation(e, s, extra=1).select("src", "dst")) == {(2, 3)}
    chain = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 2), ("b", 5, 6), ("c", 1, 2)], "flow string, src long, dst long")
    assert {(r.flow, r.strength) for r in evidence.call_chain(graph.chain_connected(chain)).collect()} == {("a", "high"), ("b", "low"), ("c", "medium")}
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "node long")
    assert pairs(graph.levels(e, n)) == {(9, 0), (1, 1), (2, 2), (3, 3), (4, 4)}
    back = spark.createDataFrame([(3, 2), (2, 1), (1, 1), (2, 8)], "src long, dst long")  # larger to smaller, a loop, an end outside
    assert pairs(graph.levels(back, n)) == {(3, 0), (2, 1), (1, 2), (4, 0), (9, 0)}
    ring = spark.createDataFrame([("f", 1, 2), ("f", 2, 3), ("f", 3, 1), ("f", 3, 4), ("g", 4, 3)], "flow string, src long, dst long")
    own = ring.select("flow", F.explode(F.array("src", "dst")).alias("node"))
    assert pairs(graph.levels(ring, own, "flow").select("flow", "node", "level")) == {("f", 1, 0), ("f", 2, 1), ("f", 3, 2), ("f", 4, 3), ("g", 4, 0), ("g", 3, 1)}
    assert graph.levels(e, n.limit(0)).collect() == []


def test_flows(spark):
    he = spark.createDataFrame([("h1", "Queue.enqueue"), ("h2", "Queue.dequeue"), ("h3", "formatTimestamp")], "hunk_id string, entity string")
    f = {r.flow: (r.n_hunks, r.hunks, r.position) for r in flows.structural(he).collect()}
    assert f == {"Queue": (2, ["h1", "h2"], 0), "top-level": (1, ["h3"], 1)}
    fh = flows.membership(he)
    assert flows.uncovered(he, fh).count() == 0 and flows.uncovered(he, fh.where("flow <> 'Queue'")).count() == 2
    assert pairs(flows.orphaned_by_removal(fh)) == {("Queue", 2), ("top-level", 1)}
    names = spark.createDataFrame([("ok-name",), ("Misc",), ("ab",), ("x" * 49,)], "n string")
    assert [r[0] for r in names.select(flows.name_error(F.col("n"))).collect()] == [None, "NAME_RESERVED", "NAME_TOO_SHORT", "NAME_TOO_LONG"]
    a = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3")], "flow string, hunk_id string")
    b = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "2"), ("q", "3")], "flow string, hunk_id string")
    j = flows.jaccard_pairs(a, b)
    assert {(r.flow_a, r.flow_b): r.jaccard for r in j.collect()} == {("x", "p"): 1.0, ("x", "q"): 0.333333, ("y", "q"): 0.5}
    assert {(r.flow_a, r.flow_b) for r in flows.greedy_pairs(j).collect()} == {("x", "p"), ("y", "q")}
    large_first = spark.createDataFrame([("a1", "b1", 0.3, 3, 6), ("a2", "b1", 0.5, 2, 0)], "flow_a string, flow_b string, jaccard double, shared long, a_only long")
    assert [(r.flow_a, r.flow_b) for r in flows.greedy_pairs(large_first).collect()] == [("a1", "b1")]
    assert flows.agreement(j, a, b).first().agreement == 1.0


def test_cost_rules(spark):
    rows = [("base", "view", "A.heavy", 10.0), ("base", "click", "A.heavy", 6.0), ("base", "view", "shared", 9.0), ("head", "view", "shared", 4.0), ("head", "purchase", "new", 5.0)]
    e = spark.createDataFrame(rows, "side string, probe string, entity string, cost double")
    fe = spark.createDataFrame([("gone", "A.heavy"), ("less", "shared"), ("more", "new")], "flow string, entity string")
    axes = cost.axes(cost.attribute(fe, e))
    net = {r.flow: r.net for r in cost.flow_cost(axes).collect()}
    assert net == {"gone": -16, "less": 0, "more": 5}
    summed = {r.flow: r.n for r in cost.drivers(axes).groupBy("flow").agg(F.sum("axis").alias("n")).collect()}
    assert summed == {"gone": -16, "more": 5}
    assert {(r.flow, r.confidence) for r in cost.confidence(axes, fe).collect()} == {("gone", 0.85), ("less", 0.3), ("more", 0.55)}


def test_claims(spark):
    ff = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), *[("c", f"f{i}") for i in range(4)]], "flow string, file string")
    assert {(r.flow, r.claim, r.strength) for r in evidence.file_scope(ff).collect()} == {("a", "single-file", "high"), ("b", "cross-file", "medium"), ("c", "cross-file", "low")}
    sig = spark.createDataFrame([("a", 1, "job opts: Retry"), ("a", 2, "job, opts"), ("b", 1, "xx yy")], "flow string, hunk_id long, signature string")
    assert [(r.flow, r.shared, r.strength) for r in evidence.signature_consistency(sig).collect()] == [("a", 2, "high")]
    runs = spark.createDataFrame([("t", 0, 1), ("u", 1, 0), ("v", 1, 1)], "kind string, base_exit long, head_exit long")
    assert {(r.kind, r.strength) for r in evidence.run_claims(runs).collect()} == {("t", "high"), ("u", "medium")}
    claims = spark.createDataFrame([(1, ["nope", "run"]), (2, ["Q.run"]), (3, ["zzz"])], "claim_id long, entities array<string>")
    n = spark.createDataFrame([("base", 7, "b.ts", "Q.run"), ("head", 4, "h.ts", "W.run")], "side string, node_id long, file string, name string")
    assert pairs(evidence.anchor(claims, n).select("claim_id", "rank", "file")) == {(1, 1, "h.ts"), (2, 2, "b.ts")}
    found = spark.createDataFrame([(1, "head", "a", i) for i in range(12)] * 2, "claim_id long, side string, file string, line int")
    have = spark.createDataFrame([(1, 4)], "claim_id long, n_refs int")
    assert evidence.references(have, found).count() == 6


def test_state_tables(spark):
    t = spark.createDataFrame([("k", "pending", 1, 10), ("m", "ready", 1, 5)], "key string, status string, created int, at int")
    u = spark.createDataFrame([("k", "ready", 2, 20)], "key string, status string, created int, at int")
    got = {r.key: (r.status, r.created) for r in state.upsert(t, u, ["key"], "at", ["created"]).collect()}
    assert got == {"k": ("ready", 1), "m": ("ready", 1)}
    a, b = (spark.createDataFrame(x, "file string, r string") for x in ([("f", "1"), ("f", "2")], [("f", "2"), ("f", "1")]))
    sha = lambda df: state.snapshot_hash(df, F.concat_ws("|", "file", "r")).first().sha
    assert sha(a) == sha(b) != sha(a.where("r = '1'"))
    merged = state.merge_passes(a.select(F.col("r").alias("flow")), {"cost": (spark.createDataFrame([("1", 5), ("9", 7)], "flow string, net int"), ["net"])})
    assert pairs(merged.select("flow", "net")) == {("1", 5), ("2", None), ("9", 7)}


def test_text_functions(spark):
    df = spark.createDataFrame([("src/a/../b/./c.ts", "x"), ("../up", "x"), ("/abs", "x"), ("C:\\x", "x")], "p string, q string")
    assert [r[0] for r in df.select(tx.resolved_path(F.col("p"))).collect()] == ["src/b/c.ts", None, None, None]
    t = spark.createDataFrame([("src/foo.test.ts", True), ("tests/a.ts", True), ("src/latest/x.ts", False), ("a/spec/b.ts", True)], "p string, want boolean")
    assert all(r[0] == r[1] for r in t.select(tx.is_test_path(F.col("p")), "want").collect())
    j = spark.createDataFrame([('say {"a": "}", "b": {"c": 1}} done',), ("none",), ("{ open",)], "t string")
    assert [r[0] for r in j.select(tx.balanced_object(F.col("t"))).collect()] == ['{"a": "}", "b": {"c": 1}}', None, None]
    args = spark.createDataFrame([('{"k": 1}',), ('"{\\"k\\": 1}"',), ("{&quot;k&quot;: 1}",), ("k=1 z=2",), ('["{\\"k\\": 1}"]',), ("??",)], "t string")
    assert [r[0] for r in args.select(F.get_json_object(tx.repaired_arguments(F.col("t")), "$.k")).collect()] == ["1"] * 5 + [None]
    one = spark.createDataFrame([("pr-0001-add-retry", "/** @param {T} a first\n @param [b=2] */")], "s string, d string")
    assert tuple(one.select(tx.slug_title(F.col("s")), tx.doc_params(F.col("d"))).first()) == ("Add retry", ["a", "b"])
    f = spark.createDataFrame([("```json\n{}\n```",)], "t string")
    assert f.select(tx.fence_free(F.col("t"))).first()[0] == "{}"
    assert spark.createDataFrame([("ab\ncd\n",)], "t string").select(tx.line_of(F.col("t"), F.lit(4))).first()[0] == 2
    m = spark.createDataFrame([(["A", " ", "x/y", "b.ts", "C"],)], "e array<string>")
    assert m.select(tx.clean_members(F.col("e"))).first()[0] == ["A", "C"]


def test_reports(spark):
    text = "SF:src/a.ts\nLF:10\nLH:7\nend_of_record\nSF:src/b.ts\nLF:5\nLH:5\nend_of_record\nSF:none\nLF:0\nLH:0\nend_of_record\n"
    assert pairs(reports.lcov(spark.createDataFrame([(text,)], "text string"))) == {("src/a.ts", 700), ("src/b.ts", 1000)}
    js = spark.createDataFrame([('{"total":{"lines":{"pct":1}},"src/a.ts":{"lines":{"pct":50}}}',)], "text string")
    assert pairs(reports.coverage_json(js)) == {("src/a.ts", 500)}
    assert reports.coverage_json(spark.createDataFrame([('{"a":{"lines":{"pct":50}},"b":{}}',)], "text string")).count() == 0
    lines = spark.createDataFrame([("src/foo.ts(10,12): error TS2322: bad",), ("src\\bar.ts(1,2): warning TS1: x",), ("noise",)], "line string")
    assert pairs(reports.compiler_lines(lines).select("file", "at_line", "code")) == {("src/foo.ts", 10, "TS2322"), ("src/bar.ts", 1, "TS1")}
    out = spark.createDataFrame([(" FAIL  src/foo.test.ts > x",), ("❯ src/bar.spec.ts (3 tests | 1 failed)",), ("\x1b[31mFAIL packages/ui/Button.test.tsx\x1b[0m",), ("ok",)], "line string")
    assert {r.file for r in reports.failing_tests(out).collect()} == {"src/foo.test.ts", "src/bar.spec.ts", "packages/ui/Button.test.tsx"}
    roots = spark.createDataFrame([("packages/core", "@x/core"), ("packages/core/sub", "@x/sub")], "root string, package string")
    files = spark.createDataFrame([("packages/core/a.ts",), ("packages/core/sub/b.ts",), ("else/c.ts",)], "file string")
    assert pairs(reports.packages(files, roots)) == {("packages/core/a.ts", "@x/core"), ("packages/core/sub/b.ts", "@x/sub"), ("else/c.ts", None)}
    y = spark.createDataFrame([(".", "pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  - apps/*\n")], "root string, file string, content string")
    assert pairs(reports.workspace_globs(y)) == {(".", "packages/*"), (".", "apps/*")}


def test_tree(spark, tmp_path):
    (tmp_path / "t" / "src").mkdir(parents=True)
    (tmp_path / "t" / "node_modules").mkdir()
    code = 'import { send as s } from "./net";\nexport type State = "idle" | "busy";\nexport async function run(a: number) {\n}\nconst f = (x) => x;\ninterface Shape {\n'
    (tmp_path / "t" / "src" / "a.ts").write_text(code)
    (tmp_path / "t" / "node_modules" / "b.ts").write_text(code)
    files = tree.source_files(spark, str(tmp_path / "t"))
    assert [r.file for r in files.collect()] == ["src/a.ts"]
    lines = tree.lines_of(files)
    got = {r.name: (r.kind, r.exported, r.variants) for r in tree.declarations(lines).collect()}
    assert got == {"State": ("state", True, ["idle", "busy"]), "run": ("function", True, None), "f": ("function", False, None), "Shape": ("type", False, None)}
    assert pairs(tree.imports(lines)) == {("src/a.ts", "s", "send", "./net")}
    assert tree.grep(lines, "run", before=1).count() == 2 and tree.grep_counts(lines, "export").first().matches == 2
    wanted = spark.createDataFrame([("src/a.ts", "src/net")], "file string, path string")
    there = spark.createDataFrame([("src/net/index.ts",), ("src/net.tsx",)], "file string")
    assert tree.resolved_modules(wanted, there).first().target == "src/net.tsx"
    st = spark.createDataFrame([("f", "S", ["idle", "busy"])], "file string, state string, variants array<string>")
    lit = spark.createDataFrame([("f", "idle", "busy"), ("f", "idle", "idle"), ("f", "idle", "other")], "file string, from string, to string")
    assert pairs(tree.transitions(lit, st)) == {("f", "S", "idle", "busy")}


def test_review(spark):
    v = spark.createDataFrame([(1, 1, "delivers", "strong", False, True), (1, 2, "partial", "strong", False, True), (2, 3, "delivers", "strong", False, True), (3, 4, "unrelated", "strong", False, True), (4, 5, "delivers", "strong", True, True), (5, 6, "delivers", "strong", False, False)], "analysis_id long, flow_id long, fit string, proof string, analysing boolean, has_intent boolean")
    assert {r.analysis_id: (r.state, r.weakest) for r in review.ship_readiness(v).collect()} == {1: ("caution", 2), 2: ("ready", None), 3: ("blocked", 4), 4: ("pending", None), 5: ("no-intent", None)}
    lines = spark.createDataFrame([("f", i, f"l{i}") for i in range(1, 21)], "file string, line long, content string")
    clip = review.around(lines.withColumn("c", F.col("line").isin(5, 18)), ["file"], "c", 2).groupBy("block").count()
    assert pairs(clip) == {(1, 5), (2, 5)}
    notes = spark.createDataFrame([(1, "f", 2), (2, "none", 2)], "note_id long, file string, at long")
    got = {r.note_id: (r.context, r.missing) for r in review.note_context(notes, lines, 1).collect()}
    assert got == {1: ("  1 l1\n> 2 l2\n  3 l3", False), 2: (None, True)}


def test_breaker_rules():
    s = ("closed", 0, 20.0, 0.0)
    for i in range(3):
        s, went = progress.breaker_step(s, False, float(i))
        assert went
    assert s[0] == "open" and s[3] == 22.0
    assert progress.breaker_step(s, True, 21.0)[1] is False
    s, went = progress.breaker_step(s, False, 23.0)
    assert went and s[0] == "open" and s[2] == 40.0
    for _ in range(8):
        s, _ = progress.breaker_step(s, False, s[3])
    assert s[2] == 300.0
    s, _ = progress.breaker_step(s, True, s[3])
    assert s == ("closed", 0, 20.0, 0.0)


def test_pairing_goes_on_until_no_pair_is_left(spark):
    n = 8  # ties along a chain: one pair a round
    chain = [(f"a{i:03}", f"b{j:03}", 0.5, 1, 1) for i in range(n) for j in (i, i + 1)]
    df = spark.createDataFrame([*chain, (None, "b000", 0.9, 1, 0)], "flow_a string, flow_b string, jaccard double, shared long, a_only long").coalesce(1)
    assert sorted((r.flow_a, r.flow_b) for r in flows.greedy_pairs(df).collect()) == [(f"a{i:03}", f"b{i:03}") for i in range(n)]


def test_all_short_passages_are_found(spark):
    n = 1200
    items = [(i, f"key{i} é{i}" if i % 2 else f"word{i}.") for i in range(n)] + [(n, "z"), (n + 1, None), (n + 2, "")]
    texts = [(i, f"x{t}y") for i, t in items[:n]] + [(n, None), (n + 1, "zebra 😀 z"), (n + 2, "")]
    want = {(i, d) for i, t in items for d, x in texts if t is not None and x is not None and t in x}
    got = resolve.passages_found(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == len(want) and {(r.item_id, r.doc_id) for r in got} == want
    assert resolve.passages_found(spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")).collect() == []


def test_pairing_is_the_walk_by_size(spark):
    import random

    r = random.Random(2)
    rows = [(f"a{i}", f"b{j}", round(r.random(), 1), r.randrange(1, 3), 0) for i in range(9) for j in range(9) if r.random() < 0.5]
    size = {a: 10 + r.randrange(4) for a, *_ in rows}
    rows = [(a, b, j, s, size[a] - s) for a, b, j, s, _ in rows]
    free, want = {b for _, b, *_ in rows}, set()
    for a in sorted(size, key=lambda a: (-size[a], a)):
        best = min(((-j, b) for x, b, j, *_ in rows if x == a and b in free), default=None)
        if best:
            free.discard(best[1])
            want.add((a, best[1]))
    df = spark.createDataFrame(rows, "flow_a string, flow_b string, jaccard double, shared long, a_only long")
    assert {(x.flow_a, x.flow_b) for x in flows.greedy_pairs(df).collect()} == want


def test_labels_positions_and_paths(spark):
    one = lambda *cols: spark.range(1).select(*cols).first()
    text = F.lit("ab\n\U0001f600xyz\nlast")
    assert tuple(one(tx.position_of(text, F.lit(5)).alias("p")).p) == (2, 4) and tuple(one(tx.position_of(text, F.lit(99)).alias("p")).p) == (1, 1)
    assert tuple(one(tx.name_position(text, F.lit(1), F.lit(9), F.lit("xyz")).alias("p")).p) == (1, 2) and one(tx.name_position(text, F.lit(0), F.lit(4), F.lit("xyz")).alias("p")).p is None
    strings = "short_id is_path_id flow_label provider_model".split()
    got = one(*(getattr(tx, f)(F.lit(x)).alias(f"{f}_{i}") for f in strings for i, x in enumerate(("<structural: x>", "\\\\host\\share", "pp: m:1"))))
    assert got.flow_label_0 == "X" and got.is_path_id_1 and not got.is_path_id_0 and got.short_id_1 == "share" and tuple(got.provider_model_2) == ("pp", "m:1") and tuple(got.provider_model_0) == ("<structural", "x>")
    assert one(tx.without_comments(F.lit('{"a": "b // c \\" //", // d\n"e": 1}')).alias("x")).x == '{"a": "b // c \\" //", \n"e": 1}'
    assert one(tx.preview(F.lit(" " + "x" * 80 + " ")).alias("x")).x == "x" * 80 and one(tx.preview(F.lit("y" * 81)).alias("x")).x == "y" * 77 + "…"
    assert tuple(one(tx.error_title(F.lit("fatal")).alias("x")).x) == ("Something went wrong", None)
    files = spark.createDataFrame([("src/a.ts",), ("src/x/y/b.tsx",), ("lib/a.ts",), ("src/a.rs",)], "file string")
    assert {r.file for r in tree.matching(files, "src/**/*.{ts,tsx}").collect()} == {"src/a.ts", "src/x/y/b.tsx"}
    assert {r.file for r in tree.matching(files, "*/a.??").collect()} == {"src/a.ts", "lib/a.ts", "src/a.rs"}


def test_listings_changes_and_stores(spark, tmp_path):
    from snapdelta.operators import listing

    n = spark.createDataFrame([("base", 1, "f", "a"), ("head", 2, "f", "a"), ("head", 3, "g", "b"), ("base", 4, "g", "c"), ("base", 5, "g", "d")], "side string, node_id long, file string, name string")
    assert pairs(listing.listed(n, ["file"], most=2)) == {("f", "head", 2, "a", 1, None), ("f", "base", 1, "a", 2, None), ("g", None, None, None, 3, "RESULTS_TOO_LARGE")}
    shown = listing.one_side({"nodes": n, "flows": n, "coverage": n}, "head")
    assert [shown[x].count() for x in ("nodes", "flows", "coverage")] == [2, 0, 2]
    listing.spilled(n, str(tmp_path / "spill"))
    assert spark.read.json(str(tmp_path / "spill")).count() == 5
    docs = spark.createDataFrame([("k1", "{}"), ("k2", "[1]")], "key string, json string")
    folder = str(tmp_path / "cache")
    state.put_documents(docs, folder, version=1)
    state.put_documents(docs.where("key = 'k2'").withColumn("json", F.lit("[2]")), folder, version=2)
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    assert pairs(state.get_documents(spark, folder, wanted).select("key", "json")) == {("k1", "{}"), ("k2", "[2]"), ("k3", None)}
    state.compact_documents(spark, folder, folder + "-2")
    assert pairs(state.get_documents(spark, folder + "-2", wanted).select("key", "json")) == {("k1", "{}"), ("k2", "[2]"), ("k3", None)}
    assert state.get_documents(spark, folder, wanted.limit(0)).count() == 0
    edges = spark.createDataFrame([(0, 1, 2, "calls"), (0, 1, 3, "defines"), (1, 1, 2, "calls")], "analysis long, src long, dst long, kind string")
    answers = spark.createDataFrame([(0, 1, 3), (0, 1, 3), (0, 1, 1)], "analysis long, src long, dst long")
    runs = lambda *rows: spark.createDataFrame(rows, "analysis long, ok boolean")
    failed, some = (1, 1, 2, "calls"), {(0, 1, 3, "defines")}
    assert pairs(tree.replaced_calls(edges, answers, runs((0, True), (1, False)))) == some | {(0, 1, 3, "calls"), failed}
    assert pairs(tree.replaced_calls(edges, answers.limit(0), runs((0, True)))) == some | {failed}  # no answer: no calls
    assert pairs(tree.replaced_calls(edges, answers, runs((0, False)))) == some | {(0, 1, 2, "calls"), failed}
    failing = spark.createDataFrame([("g",)], "file string")
    fe = spark.createDataFrame([("x", "b"), ("y", "a")], "flow string, entity string")
    assert pairs(resolve.flows_of_failures(fe, n.where("side = 'head'"), failing)) == {("x",)}
    assert pairs(resolve.flows_of_failures(fe, n, failing.limit(0))) == {("x",), ("y",)}


def test_a_store_of_many_keys(spark, tmp_path):
    folder = str(tmp_path / "many")
    state.put_documents(spark.range(100_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("{}").alias("json")), folder, version=1)
    files = spark.read.parquet(folder).inputFiles()
    assert len(files) <= state.BUCKETS
    one = spark.createDataFrame([("k77",)], "key string")
    got = state.get_documents(spark, folder, one)
    assert [tuple(r) for r in got.collect()] == [("k77", "{}")]
    scan = next(x for x in got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n") if "PartitionFilters" in x and "bucket" in x)
    assert re.search(r"bucket#\d+ = \d+", scan)  # one folder of 64


def test_patches(spark):
    flow = spark.createDataFrame([("f", "Name", "why"), ("g", "Other name", "why")], "flow string, name string, rationale string")
    hunks = spark.createDataFrame([("f", "h1"), ("f", "h2"), ("g", "h3")], "flow string, hunk_id string")
    known = spark.createDataFrame([("h1", "a.x"), ("h2", "b"), ("h3", "c"), ("h3", "a.x")], "hunk_id string, entity string")
    own = spark.createDataFrame([("f", "a.x", False), ("f", "b", False), ("f", "by hand", True), ("g", "c", False)], "flow string, entity string, extra boolean")
    names = spark.createDataFrame([("a.x",), ("b",), ("c",), ("by hand",), ("new",)], "entity string")
    rows = [
        ("f", None, None, ["h3", "h2"], ["h2"], ["b", "new"], ["by hand", "c"]),
        ("g", "misc", None, None, None, None, None), ("x", None, None, None, None, None, None), ("y", None, None, None, ["h9"], ["zzz"], None), ("z", None, "r" * 241, None, None, None, None),
    ]
    checked = flows.patch_errors(spark.createDataFrame(rows, flows.PATCH), flow, hunks, names)
    assert {r.flow: r.error for r in checked.collect()} == {"f": None, "g": "NAME_RESERVED", "x": "FLOW_NOT_FOUND", "y": "HUNK_NOT_FOUND", "z": "RATIONALE_TOO_LONG"}
    named, kept, entities = flows.mutated(flow, hunks, own, checked.where("error is null").drop("error"), known)
    assert pairs(named) == {("f", "Name", "why"), ("g", "Other name", "why")}
    assert pairs(kept) == {("f", "h1"), ("f", "h3"), ("g", "h3")}  # h2 was added and removed: gone
    # b was an entity of the flow when it was named by hand, so it is no extra one; now no hunk has it
    assert pairs(entities) == {("f", "a.x", False), ("f", "c", False), ("f", "new", True), ("g", "c", False)}


def test_greedy_pairs_of_chains(spark, monkeypatch):
    rows = []
    for n in range(30):  # a chain in which each pairing hangs on the one before
        rows += [(f"a{n:02}", f"b{n:02}", 5, 0, 1, 0.5), (f"a{n:02}", f"b{n + 1:02}", 5, 0, 1, 0.5)]
    rows += [("lone", "b99", 1, 1, 1, 0.3), ("late", "b99", 1, 0, 1, 0.9)]
    t = spark.createDataFrame(rows, "flow_a string, flow_b string, shared long, a_only long, b_only long, jaccard double")
    want = {(f"a{n:02}", f"b{n:02}", 0.5) for n in range(30)} | {("lone", "b99", 0.3)}
    assert pairs(flows.greedy_pairs(t)) == want
    monkeypatch.setattr(flows, "WALKED", 55)  # the chain shrinks in rounds before it is walked
    assert pairs(flows.greedy_pairs(t)) == want


def test_orphans_of_both_sides(spark):
    a = spark.createDataFrame([("x", "h1"), ("y", "h2"), ("y", "h3")], "flow string, hunk_id string")
    b = spark.createDataFrame([("p", "h1"), ("q", "h8"), ("r", "h9")], "flow string, hunk_id string")
    jac = flows.jaccard_pairs(a, b)
    got = pairs(flows.orphans(jac, flows.greedy_pairs(jac), a, b))
    assert got == {("a", "y", 2, "r", 0.0), ("b", "q", 1, "y", 0.0), ("b", "r", 1, "y", 0.0)}
    got = pairs(flows.orphans(jac, jac.limit(0), a, b.limit(0)))
    assert got == {("a", "x", 1, "p", 1.0), ("a", "y", 2, None, 0.0)}


def test_propagation_keeps_the_first(spark):
    edges = spark.createDataFrame([(1, n) for n in range(10, 40)] + [(10, 100), (39, 101), (2, 50), (50, 60), (60, 61)], "src long, dst long")
    seeds = spark.createDataFrame([("hub", 1), ("thin", 2)], "flow string, node long")
    got = {(r.flow, r.src, r.dst) for r in graph.propagation(edges, seeds).collect()}
    assert got == {("hub", 1, n) for n in range(10, 30)} | {("thin", 2, 50), ("thin", 50, 60)}
    got = {(r.flow, r.dst) for r in graph.propagation(edges, seeds, extra=31).collect() if r.flow == "hub"}
    assert got == {("hub", n) for n in range(10, 40)} | {("hub", 100)}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (None, 1), (3, 1), (20, 21), (21, 22), (22, 23), (23, 20)], "src long, dst long")
    assert pairs(graph.components(edges)) == {(1, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8), (20, 20), (21, 20), (22, 20), (23, 20)}
    assert graph.components(edges.limit(0)).count() == 0


def test_globs(spark):
    globs = {"packages/*": ("packages/a", True), "packages/**": ("packages/a/b", True), "a.b/*": ("axb/c", False), "{x,y}/z?": ("y/z1", True), "x/z?": ("x/z", False), "**/t": ("a/b/t", True), "apps/web": ("apps/web", True), "a*b/c": ("a/b/c", False)}
    rows = spark.createDataFrame([(g, p, w) for g, (p, w) in globs.items()], "glob string, path string, want boolean")
    for r in rows.select("*", F.rlike("path", reports.glob_pattern(F.col("glob"))).alias("got")).collect():
        assert r.got == r.want, r
    m = spark.createDataFrame([("r", "pnpm-workspace.yaml", "packages: ['x/*', \"y\"]\n"), ("s", "package.json", '{"workspaces": ["a/*/"]}'), ("t", "package.json", "{}"), ("u", "tsconfig.json", "not json")], "root string, file string, content string")
    assert pairs(reports.workspace_globs(m)) == {("r", "x/*"), ("r", "y"), ("s", "a/*")}
