"""Line diffs against a plain table of common subsequences, word segments, and the query of both."""

import random
import time
from collections import defaultdict

import numpy as np

from snapdelta.operators import lines
from snapdelta.plans.queries import QUERIES


def best_length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_common_is_longest(monkeypatch):
    r = random.Random(5)
    for n in range(600):
        monkeypatch.setattr(lines, "TABLE_BYTES", 64_000_000 if n % 2 else 4)  # few rows kept: the others are worked out again
        a, b = ([r.choice("abc") for _ in range(r.randrange(24))] for _ in range(2))
        got = lines.longest_common(a, b)
        assert len(got) == best_length(a, b) and all(a[i] == b[j] for i, j in got) and got == sorted(set(got))
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


def test_many_blank_lines_take_no_square_of_pairs():
    a = [x for i in range(8000) for x in (f"line {i}", "")]
    b = [x for i in range(8000) for x in (f"line {i + (i % 3 == 0) * 100_000}", "")]
    began = time.time()
    got = lines.longest_common(a, b)
    assert len(got) == 16_000 - 2667 and time.time() - began < 20


def test_rising_runs():
    r = random.Random(2)
    for _ in range(300):
        p = r.sample(range(30), r.randrange(12))
        keep = lines.rising(np.array(p, np.int64))
        run = [x for x, k in zip(p, keep) if k]
        best = max((sum(m >> i & 1 for i in range(len(p))) for m in range(1 << len(p)) if (q := [p[i] for i in range(len(p)) if m >> i & 1]) == sorted(q)), default=0)
        assert run == sorted(run) and len(run) == best


def scripts(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return by


def test_line_diff_rebuilds_both_sides(spark):
    r = random.Random(7)
    files = {}
    for f in range(60):
        base = [r.choice(["", "}", f"x{r.randrange(40)}", f"only {r.randrange(10**9)}"]) for _ in range(r.randrange(40))]
        head = [x for x in base if r.random() > 0.15]
        for _ in range(r.randrange(6)):
            head.insert(r.randint(0, len(head)), r.choice(["", "new", f"x{r.randrange(40)}"]))
        if f % 7 == 0 and len(head) > 4:
            head.append(head.pop(1))  # a line that moved
        files[f] = (base, head)
    side = lambda s: spark.createDataFrame([(f, n, t) for f, x in files.items() for n, t in enumerate(x[s], 1)] + [(None, 1, "lost")], "file long, line int, content string")
    for anchored in (True, False):
        got = scripts([(x.file, x.op, x.base_line, x.head_line, x.text) for x in lines.line_diff(side(0), side(1), "file", anchored).collect()])
        assert None not in got
        for f, (base, head) in files.items():
            rows = got.get(f, [])
            on = lambda ops, at: [x[4] for x in sorted((x for x in rows if x[1] in ops), key=lambda x: x[at])]  # noqa: B023, E731
            assert on(("keep", "remove"), 2) == base and on(("keep", "add"), 3) == head
            kept = sorted((x[2], x[3]) for x in rows if x[1] == "keep")
            assert [j for _, j in kept] == sorted(j for _, j in kept)
            assert anchored or len(kept) == best_length(base, head)


def test_line_diff_of_nothing(spark):
    none = spark.createDataFrame([], "file string, line int, content string")
    one = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], none.schema)
    assert lines.line_diff(none, none, "file").count() == 0
    assert sorted((r.op, r.head_line) for r in lines.line_diff(none, one, "file").collect()) == [("add", 1), ("add", 2)]
    assert {r.op for r in lines.line_diff(one, one, "file").collect()} == {"keep"}


def test_segments():
    ratio, a, b = lines.segments("const x = foo(1);", "const y = foo(1);")
    assert a == [("equal", "const "), ("changed", "x"), ("equal", " = foo(1);")] and b[1] == ("changed", "y") and round(ratio, 3) == round(16 / 17, 3)
    # a long word that stays outweighs four short ones that change
    ratio, a, _ = lines.segments("w" * 40 + " a b c d", "w" * 40 + " e f g h")
    assert ratio > 0.25 and a[0] == ("equal", "w" * 40 + " ")
    assert lines.segments("", "") == (0.0, [], []) and lines.segments("abc", "xyz")[0] == 0
    r = random.Random(1)
    for _ in range(200):
        x, y = ("".join(r.choice(["a", "b ", "  ", "é", "(", "\r\n", "foo"]) for _ in range(r.randrange(12))) for _ in range(2))
        ratio, a, b = lines.segments(x, y)
        assert "".join(t for _, t in a) == x and "".join(t for _, t in b) == y
        same = [t for k, t in a if k == "equal"]
        assert "".join(same) == "".join(t for k, t in b if k == "equal") and abs(ratio - len("".join(same)) / max(1, len(x), len(y))) < 1e-9
        assert len("".join(same)) >= 0 and best_length(lines.PIECE.findall(x), lines.PIECE.findall(y)) == sum(len(lines.PIECE.findall(t)) for t in same) or "\r" in x + y


def test_word_pairs_query(spark, small):
    """Each changed line meets itself and a word more, unless it repeats within a run of changes."""
    texts = {r.doc_id: r.text.split("\n") for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("text is not null").collect()}
    got = defaultdict(list)
    for r in QUERIES["q_word_pairs"](spark, small).collect():
        got[r.doc].append(r)
    for doc, old in texts.items():
        if len(set(old)) < len(old):
            continue  # which of several equal lines goes is left open
        want = {}
        for n in range(3, len(old) + 1, 3):
            line = old[n - 1]
            same = line.rstrip(" \t\f\v") if line else ""
            if len(same) / (len(line) + 7) >= 0.25:
                want[n - 1] = (round(len(same) / (len(line) + 7), 6), f"equal={same}" + (f"|changed={line[len(same):]}" if same != line else ""), f"equal={same}|changed={line[len(same):]} edited")
        assert {r.block: (r.ratio, r.removed, r.added) for r in got.get(doc, [])} == want
