"""The operators against plain versions of themselves, and on nulls, empty and long texts, repeats and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from snapdelta.llm import ann, bpe, language, mixing, quality, quotes, secrets, winnow

TEXT = "doc_id long, text string"


def quoted(rows, least=8):
    """Operator 1 by its words, over all messages in memory."""
    norm = lambda x: regex.sub(r"[^\p{L}\p{N}]+", " ", x.lower()).strip()
    runs = {}
    for c, t, text in rows:
        lines = text.split("\n")
        if not any(re.match(r"(?:[ \t]*>)+", x) for x in lines):
            runs[c, t] = [(0, [text])]
            continue
        own = []
        for x in lines:
            marks = (re.match(r"(?:[ \t]*>)+", x) or [""])[0]
            level, body = marks.count(">"), re.sub(r"^(?:[ \t]*>)+ ?", "", x)
            if own and own[-1][0] == level:
                own[-1][1].append(body)
            else:
                own.append((level, [body]))
        runs[c, t] = [(level, ["\n".join(b)]) for level, b in own]
    pieces = {k: [(level, [(-1, b[0])] + ([(i, x) for i, x in enumerate(b[0].split("\n"))] if "\n" in b[0] else [])) for level, b in own] for k, own in runs.items()}
    said = defaultdict(set)
    for (c, t), own in pieces.items():
        for level, parts in own:
            if not level:
                for _, x in parts:
                    if len(norm(x)) >= least:
                        said[norm(x)].add((c, t))
    out = {}
    for (c, t), own in pieces.items():
        linked, asked, outside = 0, Counter(), []
        for level, parts in own:
            hits = []
            for line, x in parts if level else []:
                where = said[norm(x)] if len(norm(x)) >= least else set()
                here = min((v for u, v in where if u == c), default=t)
                if here < t:
                    hits.append((line, "here", here, len(norm(x))))
                elif others := [u for u, _ in where if u != c]:
                    hits.append((line, "there", min(others), 0))
            whole = [h for h in hits if h[0] == -1]
            for _, kind, at, size in whole or hits:
                if kind == "here":
                    asked[level, at] += size
                else:
                    outside.append(at)
            linked += bool(hits)
        best = max(((-level, size, at) for (level, at), size in asked.items()), default=None)
        out[c, t] = (sum(level > 0 for level, _ in own), linked, best and best[2], min(outside, default=None))
    return out


def test_quotes_match_a_plain_version(spark):
    r = random.Random(6)
    vocab = [f"sentence number {i} about things" for i in range(14)] + ["short", "Ünïcode — text here"]
    rows = []
    for c in range(6):
        for t in range(8):
            lines = ["> " * r.choice([0, 0, 1, 1, 2]) + r.choice(vocab) for _ in range(r.randrange(1, 5))]
            rows.append((c, t, "\n".join(lines)))
    got = {(x.conv_id, x.turn): (x.n_quoted, x.n_linked, x.parent_turn, x.other_conv) for x in quotes.quotation_links(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got == quoted(rows)


def test_quotes_elsewhere_when_the_first_is_later_here(spark):
    said = "the same words once more"
    rows = [(1, 0, f"> {said}"), (1, 1, said), (2, 0, said), (3, 0, said), (3, 0, said), (4, 0, "x" * 2_000_000 + f"\n> {said}")]
    got = {(x.conv_id, x.turn): (x.n_linked, x.other_conv) for x in quotes.quotation_links(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got[1, 0] == (1, 2) and got[4, 0] == (1, 1) and got[3, 0] == (0, None)


def test_secret_bases_match_a_plain_version(spark):
    r = random.Random(3)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "abc", "x9", "/", ".", "-", "\n", "AKIA", "ABCD1234", "0123456789abcdef", "é", "ſ"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(60)))) for i in range(300)]
    pattern = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
    for x in secrets.secret_scan(spark.createDataFrame(rows, TEXT)).collect():
        text = dict(rows)[x.doc_id]
        spans = [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert x.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))


def odd(spark, more=()):
    """Null id, null, empty and long texts, repeated rows, and columns that operators use for themselves."""
    rows = [(1, "plain words of a text"), (2, None), (3, ""), (4, "words and more words " * 40_000), (5, "again"), (5, "again"), (None, "no id"), *more]
    df = spark.createDataFrame(rows, TEXT)
    for c in ("id", "lang", "score", "tie", "spans", "rank", "sid", "n_tokens", "prints", "_g", "_b", "_n", "held_out"):
        df = df.withColumn(c, F.lit("own"))
    return df


def test_odd_tables_keep_their_rows(spark):
    df, none = odd(spark), odd(spark).limit(0)
    model = language.fit(df.select("doc_id", "text", F.when(F.col("text").isNotNull(), "en").alias("lang")))
    for run in (secrets.secret_scan, bpe.encode_decode, winnow.fingerprints, lambda d: language.identify(d, model)):
        got = run(df).collect()
        assert Counter(x.doc_id for x in got) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 1})
        five = [x for x in got if x.doc_id == 5]
        assert five[0].asDict().get("edited_sha256") or five[0] == five[1]
        assert run(none).collect() == []


def test_language_scores_match_a_plain_version(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the dog the dog", "en"), (4, "und der hund", "de")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    count = defaultdict(lambda: defaultdict(Counter))
    for _, text, lang in rows:
        for w in text.split():
            count[0][w][lang] += 1
            for n in range(1, 5):
                for i in range(len(w) + 3 - n):
                    count[n][f"^{w}$"[i : i + n]][lang] += 1
    known = count
    total = {(n, x): sum(c[x] for c in t.values()) for n, t in count.items() for x in ("de", "en")}

    def log(n, g, lang):
        mean = sum(known[n][g][x] / total[n, x] for x in ("de", "en")) / 2
        return math.log(known[n][g][lang] + 1000 * mean) - math.log(total[n, lang] + 1000)

    def word(w, lang):
        if w in known[0]:
            return log(0, w, lang)
        marked, found = f"^{w}$", []
        for i in range(len(marked)):
            n = next((n for n in range(min(4, len(marked) - i), 0, -1) if marked[i : i + n] in known[n]), None)
            if n:
                found.append(log(n, marked[i : i + n], lang))
        return sum(found) / len(found) if found else 0.0

    asked = [(i, x) for i, x in enumerate(["the hund", "dogs", "unde", "katzen the", "zzz"])]
    for x in language.identify(spark.createDataFrame(asked, TEXT), model).collect():
        score = {lang: sum(word(w, lang) for w in dict(asked)[x.doc_id].split()) for lang in ("de", "en")}
        best = max(sorted(score), key=score.get)
        assert x.lang_pred == best and math.isclose(x.score, 1 / sum(math.exp(s - score[best]) for s in score.values()), rel_tol=1e-9)


def test_cosines_of_extreme_and_repeated_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e-200, -1e-200]), (3, [3.0, 4.0]), (3, [2.0, 9.0]), (3, [2.0, 9.0]), (4, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("d", F.lit(0))
    got = [(r["rank"], r.vec_id, r.score) for r in sorted(ann.nearest(df, df.where("vec_id = 0")).collect(), key=lambda r: r["rank"])]
    assert [x[:2] for x in got] == [(1, 1), (2, 3), (3, 4), (4, 2)]
    want = [1.0, 11 / math.sqrt(85) / math.sqrt(2), 1 / math.sqrt(2), 0.0]
    assert np.allclose([x[2] for x in got], want, atol=1e-15)


def test_site_posteriors_match_a_plain_version(spark):
    rows = [(i, f"calm words {i % 9}" + (" vile" if i % 4 == 0 else ""), f"h{i % 3}", f"p{i % 2}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.quality(docs, labels).collect()}
    e = {i: got[i].evidence for i, *_ in rows}
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, _, h, p in rows:
        hosts[h].append(e[i])
        paths[h, p].append(e[i])
    mean = sum(e.values()) / len(e)

    def strength(sites):
        n, s = np.array([len(v) for v in sites.values()], float), np.array([sum(v) for v in sites.values()])
        between = (n * (s / n - mean) ** 2).sum() / n.sum() - mean * (1 - mean) * len(n) / n.sum()
        return min(max(mean * (1 - mean) / max(between, 1e-9) - 1, 2.0), 10_000.0)

    a, b = strength(hosts), strength(paths)
    for i, _, h, p in rows:
        host = (sum(hosts[h]) + a * mean) / (len(hosts[h]) + a)
        site = (sum(paths[h, p]) + b * host) / (len(paths[h, p]) + b)
        odds = e[i] / (1 - e[i]) * site / (1 - site) / (mean / (1 - mean))
        assert math.isclose(got[i].site, site, rel_tol=1e-9) and math.isclose(got[i].p_bad, odds / (1 + odds), rel_tol=1e-9)


def test_quality_keeps_columns_of_its_own_output(spark):
    rows = [(i, None if i == 3 else "calm words" + " vile" * (i % 2), "s", "en") for i in range(60)] + [(5, "calm words vile", "s", "en"), (61, "calm " * 200_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("host", F.lit("x")).withColumn("_host", F.lit("y")).withColumn("path", F.lit("z"))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    once = quality.quality(docs, labels, keep_columns=True)
    twice = quality.quality(once, labels, keep_columns=True)
    assert twice.columns == once.columns == [*docs.columns, "_evidence", "_site", "_p_bad", "_keep"] and twice.count() == len(rows)
    assert {r.host + r._host + r.path for r in twice.collect()} == {"xyz"} and len({r._p_bad for r in twice.where("doc_id = 5").collect()}) == 1


def table(spark, n=1500):
    rows = [(i, "word " * (5 + i * 7 % 60), ["a", "b", "c"][i % 3], ["x", "y"][i % 2], ["t", "u", None][i // 7 % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, about string"), rows


def test_raking_to_given_targets_matches_numpy(spark):
    docs, rows = table(spark)
    targets = {"source": {"a": 0.2, "b": 0.5, "c": 0.3, "gone": 9.0}, "lang": spark.createDataFrame([("x", 1.0), ("y", 3.0)], "value string, share double"), "topic": {"t": 0.6, "u": 0.1, None: 0.3}}
    targets["source"].pop("gone")
    out = mixing.mix(docs, targets=targets, topic_col="about", share=0.3).collect()
    cell = np.zeros((3, 2, 3))
    at = lambda r: ("abc".index(r[2]), "xy".index(r[3]), ["t", "u", None].index(r[4]))
    for r in rows:
        cell[at(r)] += len(r[1].split())
    w = cell.copy()
    for _ in range(500):
        for axis, goal in enumerate(([0.2, 0.5, 0.3], [0.25, 0.75], [0.6, 0.1, 0.3])):
            shape = [1, 1, 1]
            shape[axis] = -1
            w = w * (np.array(goal) / w.sum(axis=tuple(i for i in range(3) if i != axis))).reshape(shape)
    by = {r[0]: r for r in rows}
    assert all(math.isclose(x._weight, w[at(by[x.doc_id])], rel_tol=1e-4) for x in out) and out[0]._gap < 1e-6
    assert math.isclose(sum(x._tokens * x._p for x in out), 0.3 * sum(x._tokens for x in out), rel_tol=1e-6)


def test_mixing_says_what_cannot_be_met(spark):
    rows = [(i, "some words here", "ab"[i % 2], "xy"[i % 2]) for i in range(40)]  # a is always x
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    with pytest.raises(ValueError, match="cannot be met"):
        mixing.mix(docs, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}})
    with pytest.raises(ValueError, match="no source"):
        mixing.mix(docs, targets={"source": {"z": 1.0}})


def test_mixing_of_odd_tables(spark):
    docs, _ = table(spark, 200)
    odd_rows = [(None, "one text", "a", "x", "t"), (None, "another text", "a", "x", "t"), (7, "word " * 300_000, None, None, "u"), (7, "word " * 300_000, None, None, "u"), (8, None, "b", "y", "t"), (9, " ", "b", "y", "t")]
    docs = docs.union(spark.createDataFrame(odd_rows, docs.schema))
    for c in ("_topic", "_tokens", "_weight", "_p", "_s", "_l", "_t", "tokens", "weight"):
        docs = docs.withColumn(c, F.lit("own"))
    once = mixing.mix(docs)
    twice = mixing.mix(once)
    assert once.columns == [c for c in docs.columns if c not in ("_topic", "_tokens", "_weight", "_p")] + ["_topic", "_tokens", "_weight", "_p", "_take", "_gap"] == twice.columns
    assert twice.count() == 206 and {r._s + r._t for r in twice.collect()} == {"ownown"}
    assert [r._take for r in once.where("doc_id in (8, 9) and (text is null or text = ' ')").collect()] == [False, False]
    assert len({(r._p, r._take) for r in once.where("source is null").collect()}) == 1
    counted = mixing.mix(docs.withColumn("n", F.lit(5)), tokens_col="n")
    assert {r._tokens for r in counted.select("_tokens").distinct().collect()} == {5}


def prints(grams, window):
    """Winnowing by its definition over hashed grams, as a set of hashes."""
    return {min(grams[i : i + window]) for i in range(max(len(grams) - window, 0) + 1)} if grams else set()


def test_likeness_and_edits_match_a_plain_version(spark):
    r = random.Random(9)
    rows = [(x, " ".join(r.choice(["alpha", "beta", "gamma", "é"]) + str(r.randrange(30)) for _ in range(r.choice([0, 3, 10, 40, 200])))) for x in (-(1 << 63), -5, 0, 3, 64, 1 << 40, (1 << 62) + 7, (1 << 63) - 1)]
    got = {x.doc_id: x for x in winnow.fingerprints(spark.createDataFrame(rows, TEXT), gram=3, window=4).collect()}
    order = sorted(rows, key=lambda x: -x[0])
    texts = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        m = len(t) // 3
        texts[i, 0], texts[i, 1], texts[i, 2] = t, t[: len(t) - m] + n[:m], n
        assert got[i].edited_sha256 == hashlib.sha256(texts[i, 1].encode()).hexdigest() and got[i].n_chars == len(t)
    words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"(\S{1,16})"), F.lit(1)), lambda w: F.xxhash64(w))
    grams = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 3)).bitwiseAND(F.lit(0x7FFFFFFF)))).when(F.size("w") > 0, F.array(F.xxhash64("w").bitwiseAND(F.lit(0x7FFFFFFF)))).otherwise(F.array().cast("array<bigint>"))
    df = spark.createDataFrame([(i, k, t) for (i, k), t in texts.items()], "i long, k int, text string").withColumn("w", words).withColumn("g", grams)
    sets = {(x.i, x.k): prints(list(x.g), 4) for x in df.collect()}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for i, _ in rows:
        assert math.isclose(got[i].near_edited, like(sets[i, 0], sets[i, 1])) and math.isclose(got[i].near_next, like(sets[i, 0], sets[i, 2]))


def test_next_document_of_hot_and_null_ids(spark):
    rows = [(7, f"text {i}") for i in range(60)] + [(None, f"null {i}") for i in range(40)] + [(i, f"other {i}") for i in range(-20, 6)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("tie", F.xxhash64("text"))
    got = winnow.with_next(df, ["text"]).collect()
    order = sorted(got, key=lambda x: (x.id is not None, x.id if x.id is not None else 0, x.tie), reverse=True)
    assert [x.next_text for x in order] == [x.text for x in order[1:] + order[:1]] and len(got) == len(rows)


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    line = "one line that many documents repeat word for word"
    rows = [(1, "a first text with its own words " * 5, "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, f"{line}\nfour own words here", "en", "s"), (5, f"{line}\nother things are said there", "de", "t"), (5, f"{line}\nother things are said there", "de", "t"), (None, "no id at all", "en", "s"), (6, "long words " * 100_000, "en", "t"), (7, line, "en", "s")]
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_keep", F.lit(1)).withColumn("sid", F.lit("x"))
    spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, now = now, stage(spark, now, str(tmp_path)).cache()
            assert now.columns == docs.columns and now.count() <= before.count(), name
            assert now.select("doc_id").subtract(before.select("doc_id")).count() == 0
        out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert out.count() == now.count()
    lines = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()}
    assert lines[4] == f"{line}\nfour own words here" and lines[5] == "other things are said there" and 7 not in lines and lines[3] == "" and lines[2] is None


def test_pipeline_query_equals_its_stages(spark, small):
    """run() is the stages one after the other; counted by document."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
    key = lambda df: Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, small)) == key(docs)
    assert public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_every_language_is_learned(spark):
    """One text may fill most of the table, and a language may have few rows or words."""
    from snapdelta.llm import language

    words = {"en": "the house and river went over hills quickly", "fr": "la maison avec des fleurs rouges dans jardin", "xx": "zorb qwyx vlim torq"}
    rows = [(i, words["en"], "en") for i in range(2000)] + [(2000 + i, words["fr"] + f" mot{i}", "fr") for i in range(1000)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_docs=100)
    assert model.langs == ["en", "fr"]
    rows = [(i, f"{words['en']} rare{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}", "en") for i in range(3000)] + [(5000 + i, words["xx"], "xx") for i in range(3)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_docs=1000, most_words=200)
    assert model.langs == ["en", "xx"]
    asked = [(1, "the river"), (2, "torq zorb"), (3, "rareakz rarejtd"), (4, "housing"), (5, "vlimmy")]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got == {1: "en", 2: "xx", 3: "en", 4: "en", 5: "xx"}  # rare words of the large language stay with it


def test_many_secrets_take_linear_time():
    import time

    from snapdelta.llm import secrets
    import public_tokenizers

    encoding = secrets._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    line = "0123456789abcdef" * 3 + " key-7fQzT1xW9vBn3Kd8 " + "\n"
    text = line * (5_000_000 // len(line))
    began = time.time()
    base = secrets.base_spans(text)
    more = secrets.random_spans(text, base, encoding, 2.0)
    assert len(base) == len(text) // len(line) and len(more) == len(base) and time.time() - began < 60
    plain = [(a, b) for a, k, b in more if not any(x < b and a < y for x, _, y in base[:50])]
    assert len(plain) == len(more)
    assert secrets.covered([(5, 0, 9), (1, 2, 3), (8, 1, 12), (2, 0, 3)]) == ([1, 5], [3, 12])


def test_blank_texts_have_no_tokens(spark):
    from snapdelta.llm import mixing

    rows = [(1, "\n\n"), (2, "\t \n"), (3, " a  b\nc "), (4, None), (5, "")]
    got = {r.doc_id: (r._tokens, r._topic, r._take) for r in mixing.mix(spark.createDataFrame([(i, t, "s", "l") for i, t in rows], "doc_id long, text string, source string, lang string"), share=1.0).collect()}
    assert got[1] == (0, "none", False) and got[2] == (0, "none", False) and got[3][0] == 3 and got[3][2] and got[4][0] == got[5][0] == 0
    blank = spark.createDataFrame([(1, "\n", "s", "l")], "doc_id long, text string, source string, lang string")
    assert not mixing.mix(blank, targets={"source": {"s": 1.0}, "lang": {"l": 1.0}}).first()._take


def test_a_mix_that_does_not_settle_is_told(spark):
    import pytest as pt

    from snapdelta.llm import mixing

    docs = spark.createDataFrame([(i, "w " * (i + 1) ** 2, f"s{i % 3}", f"l{i % 4 % 3}") for i in range(30)], "doc_id long, text string, source string, lang string")
    with pt.warns(UserWarning, match="did not settle"):
        out = mixing.mix(docs, targets=None, alpha=0.2, rounds=1, most_gap=1e-9)
    assert out.first()._gap > 1e-9
