"""Operators 2 and 5 against brute force, and their edge cases."""

import random
from collections import defaultdict

import pytest

from pyspark.sql.functions import lit

from snapdelta.llm.common import connected_components
from snapdelta.llm.line_dedup import line_dedup
from snapdelta.llm.ngram_join import ngram_jaccard, one_of_each


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def links(sets, num, den):
    seen, out = defaultdict(list), []
    for i, s in enumerate(sets):
        near = {j for x in s for j in seen[x]}
        out += [(j, i) for j in near if den * len(s & sets[j]) >= num * len(s | sets[j])]
        for x in s:
            seen[x].append(i)
    return out


def texts(seed, n=160, words=60):
    """Random texts, copies, near copies in families, very long ones and odd ones."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 2, 3, 8, words, 4 * words]))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = list(base[i % len(base)])
        for _ in range(r.choice([0, 0, 1, 2, 5]) * len(w) // 60):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    return [*out, "", "  \n ", "Same Words", "same words", "É é\x0bx\x1cy tab\tsep\x0cform \u3000 z", "É é x\x1cy tab sep form \u3000 Z", " ".join(r.choice(vocab) for _ in range(6000))]


def expected(ids, sets, num, den):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links(sets, num, den):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(x, low.get(find(i), x))
    return {x: (len(sets[i]), low[find(i)]) for i, x in enumerate(ids)}


def check_join(spark, rows, k, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(df, shingle=k, num=num, den=den).collect()}
    assert got == expected([i for i, _ in rows], [shingles(t, k) for _, t in rows], num, den)


def test_join_matches_brute_force_at_nine_tenths(spark):
    check_join(spark, [(3 * i + 1, t) for i, t in enumerate(texts(1))], 3, 9, 10)


def test_join_matches_brute_force_at_eight_tenths(spark):
    check_join(spark, [(1000 - i, t) for i, t in enumerate(texts(2, words=120))], 5, 4, 5)


def test_join_of_a_large_family_is_dealt_in_blocks(spark, monkeypatch):
    from snapdelta.llm import simjoin

    monkeypatch.setattr(simjoin, "BLOCK_SETS", 16)
    r = random.Random(5)
    base = [f"a{i}" for i in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(200)] = f"b{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    check_join(spark, rows, 3, 9, 10)
    monkeypatch.setattr(simjoin, "BLOCK_SETS", 3)  # families that the first block does not join: all pairs of blocks
    check_join(spark, [(1000 - i, t) for i, t in enumerate(texts(2, words=120))], 5, 4, 5)


def test_join_nulls_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "A B C D", None), (3, None, "z"), (None, "a b c d", "q")], "doc_id long, text string, sid string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard(df, shingle=3, num=9, den=10).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (None, 0, None)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard(empty).collect() == []
    kept = one_of_each(df, ngram_jaccard(df, shingle=3, num=9, den=10))
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "1", "3", "None"]


def test_join_of_repeated_rows_with_near_partners(spark, monkeypatch):
    from snapdelta.llm import simjoin

    words = [f"w{i}" for i in range(40)]
    near = " ".join([*words[:-1], "x"])
    df = spark.createDataFrame([(3, " ".join(words)), (5, near), (5, near), (8, "alone")], "doc_id long, text string")
    for sets in (simjoin.BLOCK_SETS, 1):
        monkeypatch.setattr(simjoin, "BLOCK_SETS", sets)
        joined = ngram_jaccard(df, shingle=3, num=9, den=10).collect()
        assert sorted((r.doc_id, r.component_id) for r in joined) == [(3, 3), (5, 3), (5, 3), (8, 8)]
        both = ngram_jaccard(df.union(df), shingle=3, num=9, den=10).collect()
        assert sorted((r.doc_id, r.component_id) for r in both) == [(3, 3)] * 2 + [(5, 3)] * 4 + [(8, 8)] * 2
    kept = one_of_each(df, ngram_jaccard(df, shingle=3, num=9, den=10))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (7, 3)], "a long, b long")
    assert {(r.node, r.label) for r in connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 1), (9, 8), (8, 8)}
    assert connected_components(edges.limit(0)).collect() == []


@pytest.mark.parametrize("limits", [{}, {"SHORT": 2, "FEW": 1, "MANY": 2}, {"COMMON_LEVEL": 0}, {"FEW": 0}, {"SHORT": 1, "FEW": 1, "MANY": 1, "COMMON_LEVEL": 2, "PART": 8, "_ROWS": 3, "_COLUMNS": 5}])
def test_lines_match_brute_force(spark, monkeypatch, limits):
    """Also where lists are cut short, tokens are common and sets are cut into many parts."""
    from snapdelta.llm import line_dedup as module

    for name, value in limits.items():
        monkeypatch.setattr(module, name, value)
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    lines = [" ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 4, 5, 9, 30, 120, 400]))) for _ in range(60)]
    rows = []
    for i in range(120):
        own = []
        for _ in range(r.randrange(6)):
            w = r.choice(lines).split()
            for _ in range(r.choice([0, 1, 1, 3])):
                w[r.randrange(len(w))] = r.choice(vocab)
            own.append(" ".join(w))
        rows.append(((i * 7 % 120 - 60) * (1 << 56), "\n".join(own)))
    flat = sorted((i, no, t) for i, x in rows for no, t in enumerate(x.split("\n")) if t.split())
    gone = {flat[j][:2] for _, j in links([shingles(t, 1) for _, _, t in flat], 4, 5)}
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, text in rows:
        keep = [t for no, t in enumerate(text.split("\n")) if (i, no) not in gone]
        assert got[i] == ("\n".join(keep), len(text.split("\n")) - len(keep))


def test_a_line_that_goes_meets_one_candidate(spark, monkeypatch):
    """Near copies of a line, each near all others: the places of one candidate a line are looked up, not of every pair."""
    from snapdelta.llm import line_dedup as module

    met, write = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name="step": (met.append(out.count()) if (out := write(df, name)) and name in ("nearest", "pairs", "matched") else None) or out)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(f"x{i}y{j}" if j in (i % 39, i % 39 + 1) and i else w for j, w in enumerate(words))) for i in range(60)]
    rows += [(100, f"{rows[7][1]}\n{rows[3][1]} z\nq r s t u\nq r s t u v"), (101, rows[9][1])]
    got = {r.doc_id: r.n_removed for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: 0 if i == 0 else 3 if i == 100 else 1 for i, _ in rows}
    assert met and max(met) <= len(rows)


def test_a_changed_word_in_twenty_and_a_very_long_line(spark):
    words = [f"w{i}" for i in range(20)]
    near = [*words[:9], "x", *words[10:]]
    long = [f"l{i}" for i in range(30000)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(long)), (4, " ".join([*long[:-2000], *(f"m{i}" for i in range(2000))])), (5, " ".join(long[:15000]))]
    got = {r.doc_id: r.n_removed for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_lines_of_repeated_rows_and_clashing_columns(spark):
    a, b = "one two three four five six", "one two three four five"
    df = spark.createDataFrame([(1, f"{a}\nx"), (2, f"{b}\ny"), (2, f"{b}\ny"), (3, f"z\n{a}\n{b}")], "doc_id long, text string")
    want = [(1, f"{a}\nx"), (2, "y"), (2, "y"), (3, "z")]
    for more in ("_n_lines", "_n_removed", "_gone", "gone_id", "gone_lines", "sid", "unit", "id"):
        df = df.withColumn(more, lit("own"))
    out = line_dedup(df, keep_columns=True)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == want
    assert {r.sid + r._gone + r.gone_id + r.gone_lines for r in out.collect()} == {"ownownownown"} and {r._n_removed for r in out.collect()} == {0, 1, 2}
    again = line_dedup(out, keep_columns=True)
    assert sorted(again.columns) == sorted(out.columns) and sorted((r.doc_id, r.text, r._n_removed) for r in again.collect()) == [(*x, 0) for x in want]


def test_ids_of_sixty_four_bits(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    df = spark.createDataFrame([(high, "a b c d e f"), (low, "a b c d e f"), (1 << 45, "A B C D E F")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_jaccard(df).collect()} == {high: low, low: low, 1 << 45: low}
    assert {r.doc_id: r.n_removed for r in line_dedup(df).collect()} == {high: 1, low: 0, 1 << 45: 1}


def test_lines_edge_cases(spark):
    row = "one two three four five six"
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, f"{row}\n\n{row.upper()}", 3), (4, row, 4), (None, row, 5)], "doc_id long, text string, n_lines long")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup(df).collect()}
    assert got == {1: (None, 0, 0), 2: ("", 1, 0), 3: (f"{row}\n", 3, 1), 4: ("", 1, 1), None: (row, 1, 0)}
    assert line_dedup(df.limit(0)).collect() == []


def test_registered_line_queries_use_words_and_short_lines(spark, tmp_path):
    """One changed inner word of ten, and repeats of one to four words: both go, blank lines stay."""
    import corpus_pipeline
    from snapdelta.llm.queries import op5_line_dedup

    a, b = "a b c d e f g h i j k l", "a b c d e X g h i j k l"
    rows = [(1, f"{a}\nread more\n\n}}"), (2, f"{b}\n\nRead More\n}}\nown line"), (3, "read less")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows.append((4, f"{a}\n\n  \u00a0\t"))  # nothing but white space is left: kept by the operator, left out by the stage
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    want = {1: f"{a}\nread more\n\n}}", 2: "\nown line", 3: "read less"}
    assert {r.doc_id: r.text for r in op5_line_dedup(spark, str(tmp_path)).collect()} == want | {4: "\n  \u00a0\t"}
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()} == want
