"""Token sets of texts and of their lines, hashed from the bytes in vectorised steps."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of a token's hash.
TOKEN_BITS = 48
_TOKEN = np.uint64((1 << TOKEN_BITS) - 1)
#: Frequent tokens kept for the rarity order (a bounded broadcast; only speed depends on it).
TOP_TOKENS = 1 << 17
#: Bytes and units of one vectorised step (a longer text is a step of its own).
_BYTES, _UNITS = 500_000, 1 << 16
#: Leading bits of a token's hash by which its frequency is looked up.
_LEADING = 22
#: Tokens that a worker counts at once.
_COUNTED = 2_000_000


def tidied(run):
    """``run`` over batches, after which a worker that lives on gives freed memory back to the system."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps the memory
            ctypes.CDLL(None).malloc_trim(0)

    return tidy


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Sets(NamedTuple):
    """Token sets of some units, one after the other, each in order: where a unit stands, and what it holds."""

    row: np.ndarray
    no: np.ndarray
    n: np.ndarray
    sid: np.ndarray
    tok: np.ndarray


# Word hashes come from the bytes themselves: random values of the bytes times powers of an odd number, summed
# over the word modulo 2^64 and freed of the word's place, then mixed.
_POWER = 0x9E3779B97F4A7C15
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]  # ASCII letters in lower case
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, line) of each word of some texts, in order; lines are counted from 0 within a text."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    lo, n = offsets[0], offsets[-1] - offsets[0]
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo : lo + n]
    first = (offsets - lo)[:-1]
    edge = np.zeros(n + 1, bool)  # where a text begins or the last ends
    edge[first] = True
    edge[n] = True
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[data] * _powers(_POWER, n))])
    h = mix((sums[end] - sums[start]) * _powers(pow(_POWER, -1, 1 << 64), n)[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(first, start, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    return h, row, breaks[start] - breaks[first[row]]


def token_sets(h: np.ndarray, c: np.ndarray, rows: np.ndarray, nos: np.ndarray, k: int) -> Sets:
    """Distinct hashes of the k-word shingles of units of c words each; of the whole sequence where it is shorter."""
    start = np.cumsum(c) - c
    m = np.maximum(c - k + 1, 0)
    at = np.repeat(np.arange(len(c)), m)
    first = np.arange(len(at)) + np.repeat(start - (np.cumsum(m) - m), m)

    def gram(first: np.ndarray, length: int, seed: int) -> np.ndarray:
        out = h[first] + np.uint64(seed)
        for i in range(1, length):
            out = mix(out * np.uint64(_POWER) + h[first + i])
        return mix(out)

    toks, owners = [gram(first, k, 0)], [at]
    for length in range(1, k):
        if len(few := np.flatnonzero(c == length)):
            toks.append(gram(start[few], length, length)), owners.append(few)
    # one sort of unit number and token in one word; units of a step are fewer than 2^16
    key = np.sort((np.concatenate(owners).astype(np.uint64) << np.uint64(TOKEN_BITS)) | (np.concatenate(toks) & _TOKEN))
    keep = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=keep[1:])
    key = key[keep]
    tok, at = key & _TOKEN, (key >> np.uint64(TOKEN_BITS)).astype(np.int64)
    n = np.bincount(at, minlength=len(c))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tok ^ np.uint64(0xD6E8FEB86659FD93)))])  # wraps around
    ends = np.cumsum(n)
    sid = (mix(sums[ends] - sums[ends - n] + n.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    return Sets(rows, nos, n, sid, tok)


def sets(texts: pa.StringArray, lines: bool, k: int, least: int, wanted=None) -> Iterator[Sets]:
    """The sets of all units of some texts that have ``least`` words; ``wanted`` chooses units by row and number."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = np.cumsum(size) // _BYTES
    cut = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])) if len(step) else []
    for lo, hi in zip(cut, [*cut[1:], len(texts)]):
        part = texts.slice(lo, hi - lo)
        h, row, line = _words(part)
        if lines:
            edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])])) if len(h) else np.empty(0, np.int64)
            rows, nos, c = row[edge], line[edge], np.diff(np.concatenate([edge, [len(h)]]))
        else:
            rows = np.flatnonzero(part.is_valid().to_numpy(zero_copy_only=False))
            nos, c = np.zeros(len(rows), np.int64), np.bincount(row, minlength=len(part))[rows]
        use = c >= max(least, 1) if lines else c >= least
        if wanted is not None:
            use &= wanted(rows + lo, nos)
        h, rows, nos, c = h[np.repeat(use, c)], rows[use] + lo, nos[use], c[use]
        ends = np.cumsum(c)
        for i in range(0, len(c), _UNITS):
            j = min(i + _UNITS, len(c))
            yield token_sets(h[ends[i] - c[i] : ends[j - 1]], c[i:j], rows[i:j], nos[i:j], k)


def unit_rows(k: int, lines: bool, least: int):
    """Texts to (id, unit, n, sid) of each unit, and to counts of frequent tokens: n of token sid, in rows without a unit."""

    def counts(tok: np.ndarray) -> pa.RecordBatch:
        tok.sort()  # in place: the buffer is the largest thing a worker holds
        edge = np.flatnonzero(tok[1:] != tok[:-1]) + 1
        first = np.concatenate([[0], edge])
        n = np.diff(np.concatenate([first, [len(tok)]]))
        often = np.flatnonzero(n > 2)
        if len(often) > TOP_TOKENS:
            often = often[np.argpartition(n[often], -TOP_TOKENS)[-TOP_TOKENS:]]
        none = pa.nulls(len(often), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(n[often]), pa.array(tok[first[often]].view(np.int64))], ["id", "unit", "n", "sid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = np.empty(_COUNTED, np.uint64), 0
        for batch in batches:
            for s in sets(batch.column("text"), lines, k, least):
                ids = batch.column("id").take(pa.array(s.row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(s.no), pa.array(s.n), pa.array(s.sid)], ["id", "unit", "n", "sid"])
                for lo in range(0, len(s.tok), _COUNTED):
                    tok = s.tok[lo : lo + _COUNTED]
                    if n_held + len(tok) > _COUNTED:
                        yield counts(held[:n_held])
                        n_held = 0
                    held[n_held : n_held + len(tok)] = tok
                    n_held += len(tok)
        if n_held:
            yield counts(held[:n_held])

    return tidied(run)


def heavy_tokens(counts: DataFrame) -> np.ndarray:
    """The logarithms of the counts of the most frequent tokens of ``unit_rows``, by the leading bits of their hash. A
    rare token that shares its bits with a frequent one passes for frequent: any order of tokens that all sets keep
    gives the same links."""
    top = counts.groupBy("sid").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sid").limit(TOP_TOKENS).toPandas()
    table = np.zeros(1 << _LEADING, np.uint8)
    level = np.minimum(np.log2(np.maximum(top.n.to_numpy(np.float64), 1)) + 1, 31).astype(np.uint8)
    np.maximum.at(table, (top.sid.to_numpy(np.int64).view(np.uint64) >> np.uint64(TOKEN_BITS - _LEADING)).astype(np.int64), level)
    return table


def order_of(keys: np.ndarray) -> np.ndarray:
    """Places of small keys in their order, equal ones as they come: one plain sort of key and place in one word."""
    return np.sort((keys << 32) | np.arange(len(keys))) & 0xFFFFFFFF


def levels_of(tok: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The logarithm of each token's count, 0 for those that are not frequent."""
    return table[(tok >> np.uint64(TOKEN_BITS - _LEADING)).astype(np.int64)].astype(np.int64)


def most_apart(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most tokens in which a set of n and one at least as similar as num/den can differ."""
    return ((n + n * den // num) * (den - num)) // (den + num)


def parts_of(n: np.ndarray, part: int) -> np.ndarray:
    return (1 << np.ceil(np.log2(np.maximum(n / part, 1))).astype(np.int64)).astype(np.int64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)  # of unsigned words: of signed ones it counts absolute values
