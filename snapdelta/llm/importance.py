"""Operator 12: importance resampling towards a target, with features hashed from running CRCs.

A text is folded once: ASCII letters in lower case, each run of separators one space. Over that form the CRC-32 of
every prefix that ends a word is kept. CRCs are linear over GF(2): crc(AB) = shift(crc(A), |B|) ^ crc(B), where shift
multiplies by x^(8|B|) modulo the polynomial. So the CRC of any run of words comes from the two prefixes that bound
it, whatever its length, and no n-gram is ever built or read again.

Two passes over the texts: one counts features by bucket (a fixed number of them), the other sums each text's gains.
The draw adds Gumbel noise from a hash of the id to the weights and takes the highest scores: a sample without
replacement with chances in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ranked
from .token_sets import tidied

#: The reflected polynomial of CRC-32 (a fixed value).
POLYNOMIAL = 0xEDB88320
#: Bytes of text taken at once, and of one piece of a long text.
_STEP = 1 << 19
#: Words are runs of these bytes: digits, lower-case letters and whatever is not ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _byte_step() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return c


_BYTE = _byte_step()


def _shifts(powers: int = 31) -> np.ndarray:
    """For each power of two of zero bytes, what the four bytes of a CRC turn into."""
    column = np.uint32(1) << np.arange(32, dtype=np.uint32)
    tables, last = [], (column >> np.uint32(8)) ^ _BYTE[column & np.uint32(255)]
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(powers):
        table = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            table[bit // 8] ^= np.where((byte >> np.uint32(bit % 8)) & np.uint32(1), last[bit], np.uint32(0))
        tables.append(table)
        last = _through(table, last)
    return np.stack(tables)


def _through(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & np.uint32(255)] ^ table[1][(c >> np.uint32(8)) & np.uint32(255)] ^ table[2][(c >> np.uint32(16)) & np.uint32(255)] ^ table[3][c >> np.uint32(24)]


_SHIFT = _shifts()


def shifted(c: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved on by ``length`` zero bytes each: what is left of them in the CRC of a longer prefix."""
    c = c.copy()
    for power in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero((length >> power) & 1)
        c[on] = _through(_SHIFT[power], c[on])
    return c


def run_crcs(words: list[bytes], longest: int) -> Iterator[tuple[np.ndarray, int]]:
    """For each run length up to ``longest``: the CRC of every run of so many words joined by a space, in order."""
    ends = np.fromiter(accumulate(words, lambda c, w: crc32(w, crc32(b" ", c)), initial=0), np.uint32, len(words) + 1)
    inner = ~ends[:-1]  # the register behind a CRC; one more byte, the space, gives the prefix before each word
    starts = ~((inner >> np.uint32(8)) ^ _BYTE[(inner ^ np.uint32(32)) & np.uint32(255)])
    place = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    for n in range(1, min(longest, len(words)) + 1):
        length = place[n:] - place[:-n] - 1
        yield ends[n:] ^ shifted(starts[: len(length)], length), n


def _pieces(text: bytes, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text, in pieces of bounded size: each begins with the last words of the one before, which are told."""
    carried, lo = [], 0
    while lo < len(text):
        hi = lo + _STEP
        if hi < len(text):
            folded = text[lo:hi].translate(_FOLD)
            while folded.rfind(b" ") < 0 and hi < len(text):  # one word longer than a piece
                more = text[hi : hi + _STEP].translate(_FOLD)
                folded, hi = folded + more, hi + _STEP
            if hi < len(text):
                cut = folded.rfind(b" ")
                folded, hi = folded[:cut], lo + cut
        else:
            folded = text[lo:].translate(_FOLD)
        words = carried + folded.split()
        yield words, len(carried)
        carried, lo = words[len(words) - longest + 1 :] if longest > 1 else [], hi


def _features(texts: pa.StringArray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(crc, row) of each feature of some texts, and (rows, words) of the texts' pieces, a bounded number at once."""
    held: list[tuple[int, list[bytes], int]] = []
    size = 0

    def flush():
        words = [w for _, ws, _ in held for w in ws]
        count = np.array([len(ws) for _, ws, _ in held], np.int64)
        new = np.array([len(ws) - c for _, ws, c in held], np.int64)
        rows = np.array([row for row, _, _ in held], np.int64)
        first = np.cumsum(count) - count
        piece = np.repeat(np.arange(len(held)), count)
        fresh = np.arange(len(words)) - first[piece] >= (count - new)[piece]
        crcs, of = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for crc, n in run_crcs(words, longest):
            on = (piece[n - 1 :] == piece[: len(piece) - n + 1]) & fresh[n - 1 :]  # runs within a text, told once
            crcs.append(crc[on]), of.append(rows[piece[n - 1 :][on]])
        return np.concatenate(crcs), np.concatenate(of), rows, new

    for row, text in enumerate(texts):
        text = text.as_buffer()
        for words, carried in _pieces(text.to_pybytes() if text is not None else b"", longest):
            held.append((row, words, carried))
            size += sum(map(len, words))
            if size > _STEP:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _counts(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for crc, *_ in _features(batch.column("text"), longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return tidied(run)


def bucket_counts(docs: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket. What comes to the driver is one number for each of ``buckets``."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_counts(longest, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in found.collect():
        total[r.bucket] = r.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket speaks for the target: thousandths of a log ratio, with one feature added to each."""
    k, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = lambda a, b: (b + 1.0) * (s + k) / ((a + 1.0) * (t + k))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def _weights(longest: int, gain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = gain.value
        for batch in batches:
            n, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for crc, row, rows, new in _features(batch.column("text"), longest):
                np.add.at(n, row, 1)
                np.add.at(weight, row, value[crc % np.uint32(len(value))])
                np.add.at(words, rows, new)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c) for c in (n, words, weight))], ["id", "n_features", "n_words", "weight"])

    return tidied(run)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """(id, n_features, weight, score, rank): how much each text of ``docs`` looks like those of ``target``, and which
    are drawn.

    Words are runs of ASCII digits, ASCII letters (in lower case) and characters beyond ASCII; features are all runs of
    one to ``longest`` words joined by a space, repeats counted, by the CRC-32 of their UTF-8 bytes modulo ``buckets``.
    weight sums floor(1000 ln(((t+1)(S+k)) / ((s+1)(T+k)))) over the features of a text; score adds the noise of the id.
    Of the N texts of ``least_words`` words or more the floor(percent N / 100) highest scores are drawn and ranked from 1,
    ties by smaller id; others have a null rank.

    A null, empty or wordless text has no features and weight 0. A row of null id has no noise: null score, never drawn,
    not one of N. Repeated rows count, and are drawn, one by one. An empty target or table needs no special case. Long
    texts are read in pieces of half a megabyte (a longer word is a piece of its own). Other columns are ignored."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    weighed = narrow.mapInArrow(_weights(longest, spark.sparkContext.broadcast(gain)), "id long, n_features long, n_words long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise), "scored")
    fits = F.coalesce((F.col("n_words") >= least_words) & F.col("id").isNotNull(), F.lit(False))
    best = ranked(scored.where(fits), "rank", F.desc("score"), F.asc("id"))
    drawn = percent * scored.where(fits).count() // 100
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = best.unionByName(scored.where(~fits).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
