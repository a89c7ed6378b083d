"""Operator 4: language identification, words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
#: Words by which a language's frequencies lean on the average of all.
LEAN = 1000.0
_MEMO = 1 << 19


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                words[lang].update(WORD.findall(text.lower()))
        rows = []
        for lang, seen in words.items():
            grams: Counter = Counter()
            for w, c in seen.items():
                rows.append((lang, 0, w, c))
                marked = f"^{w}$"
                for n in range(1, LONGEST + 1):
                    for i in range(len(marked) - n + 1):
                        grams[n, marked[i : i + n]] += c
            rows += [(lang, n, g, c) for (n, g), c in grams.items()]
        cols = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["lang", "n", "gram", "count"])


class Model:
    """Log frequencies by language of known words and n-grams.

    A frequency leans on what all languages have on average, by as much as ``LEAN`` more words would weigh: a language of
    few words has no higher floor than one of many, so that the rare words of a large language don't fall to a small one."""

    def __init__(self, rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int], langs: list[str]):
        self.langs = langs
        at = {x: i for i, x in enumerate(langs)}
        count: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for lang, n, gram, c in rows:
            count[n].setdefault(gram, np.zeros(len(langs)))[at[lang]] += c
        tables = []
        for n, table in enumerate(count):
            total = np.array([float(totals.get((x, n), 0)) for x in langs])
            logs = {}
            for g, c in table.items():
                mean = (c / np.maximum(total, 1.0)).mean()
                logs[g] = np.log(c + LEAN * mean) - np.log(total + LEAN)
            tables.append(logs)
        self.words = tables[0]
        grams = [(g, v) for t in tables[1:] for g, v in t.items()]
        self.gram_row = {g: i for i, (g, _) in enumerate(grams)}
        self.gram_table = np.array([v for _, v in grams]).reshape(len(grams), len(langs))

    def score(self, w: str) -> np.ndarray:
        """A known word's log frequencies; else the mean of the longest known n-grams at its characters."""
        got = self.words.get(w)
        if got is not None:
            return got
        marked, rows = f"^{w}$", []
        for i in range(len(marked)):
            for n in range(min(LONGEST, len(marked) - i), 0, -1):
                row = self.gram_row.get(marked[i : i + n])
                if row is not None:
                    rows.append(row)
                    break
        return self.gram_table[rows].mean(axis=0) if rows else np.zeros(len(self.langs))

    def predict(self, text: str | None, seen: _Rows) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        score = seen.total(words)
        best = int(score.argmax())
        return self.langs[best], float(1 / np.exp(np.maximum(score - score[best], -700)).sum())


class _Rows(dict):
    """Words to rows of a table of their scores, which starts anew when it is full."""

    def __init__(self, model: Model):
        self.model, self.table = model, np.zeros((1024, len(model.langs)))

    def __missing__(self, w: str) -> int:
        at = self[w] = len(self)
        if at >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.model.score(w)
        return at

    def total(self, words: list[str]) -> np.ndarray:
        if len(self) > _MEMO:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[rows].sum(axis=0)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = 5_000, most_words: int = 20_000, most_grams: int = 8_000) -> Model:
    """Learn from the rows that have a language and a text; every language among them is learned.

    The sample is bounded for each language: about ``most_docs`` of its rows, chosen by the hash of id and text (all of
    a smaller language), and its most frequent ``most_words`` words and ``most_grams`` n-grams of each length. Languages
    are few by nature; the driver holds their tables. An empty table gives a model without languages, of which all texts
    are ``und``."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    spark, share = docs.sparkSession, 1 << 20
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    kept = spark.createDataFrame([(x, min(share, math.ceil(share * most_docs / n))) for x, n in sizes.items()], "lang string, kept long")
    sample = rows.join(F.broadcast(kept), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(share)) < F.col("kept"))  # one row a language
    counts = sample.select("lang", "text").mapInArrow(_counts, "lang string, n long, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    counts = materialise(counts, "grams")
    totals = {(r["lang"], r["n"]): r["t"] for r in counts.groupBy("lang", "n").agg(F.sum("count").alias("t")).collect()}
    place = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "gram"))
    often = counts.withColumn("place", place).where(F.col("place") <= F.when(F.col("n") == 0, most_words).otherwise(most_grams)).select("n", "gram").distinct()
    got = counts.join(often, ["n", "gram"]).select("lang", "n", "gram", "count").toPandas()
    return Model(list(got.itertuples(index=False, name=None)), totals, langs)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        seen = _Rows(m)
        for batch in batches:
            found = [m.predict(t.as_py(), seen) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row; score is the posterior of the language under even priors.

    A known word counts by its log frequency in each language, an unseen one by the mean log frequency of the
    longest known n-grams at its characters, up to four long, down to one. Null texts and texts without a
    letter are ``und`` with score 0, and so is all if nothing was learned. Repeated rows come back as often as
    given; other columns are ignored. An empty table gives an empty result. A long text is scored as a whole, at about a
    hundred bytes of memory a word."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return base.mapInArrow(_predict(sent), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
