"""Operator 11: near duplicates by SetSketch registers.

A sketch has M registers. Register i holds floor(1 - log_b h), where h is the least of the exponentially distributed
values that the tokens of a set have there: sketches of parts merge by the larger register, and two sets agree in a
register with a chance of about their Jaccard similarity (b is close to 1). The values of one token come in rising
order, the j-th from the j-th of M equally likely intervals (a truncated exponential), each for another register; a
token is done as soon as its next value cannot raise the lowest register. A large set costs about one value a token.

1. One pass over the texts: sketch, size and identity of each set. Equal sets are one class from here on.
2. Bands of ``ROWS`` registers are keys. Sets alone under a key go, and of keys with the same sets all but one; then
   pairs are judged from the sketches by their joint likelihood: where the registers say, beyond a likelihood ratio of
   e^``SLACK``, that the similarity is below the bound, the pair is no candidate. A key gives links that span its
   candidates, never its pairs; a key of more than ``BLOCK`` sets is dealt out as pairs of blocks.
3. The candidates' components are verified on the full sets (simjoin.classes_of).

Two sets of a similarity of just 0.8 share no band with a chance of (1 - 0.8^4)^32, 5 in 10^8, and are judged too far
apart with a chance of about e^-``SLACK``; more similar ones are safer still. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .simjoin import _by_key, _Forest, classes_of, components, whole_sets
from .token_sets import Sets, mix, sets, tidied

#: Registers (a power of two), registers of a band, base, and the rate of the values.
M, ROWS, BASE, RATE = 128, 4, 1.001, 20.0
#: Largest register value: 16 bits.
_TOP = 65535
#: The natural logarithm of the likelihood ratio by which a pair is given up.
SLACK = 16.0
#: Keys of up to so many sets are compared by steps; longer ones set by set; beyond BLOCK in pairs of blocks.
SHORT, BLOCK = 24, 4096
#: Pairs of a longer key that are compared at once.
_PAIRS = 4096


def _register(j: int, seed: np.ndarray) -> np.ndarray:
    """The register of each token's j-th value: a permutation of the registers for each token."""
    m = np.uint64(M - 1)
    at = np.full(len(seed), j, np.uint64)
    for lo in (0, 14, 28):
        at = (at * ((seed >> np.uint64(lo)) | np.uint64(1)) + (seed >> np.uint64(lo + 7))) & m
        at ^= at >> np.uint64(3)
    return at.astype(np.int64)


def sketches(s: Sets) -> np.ndarray:
    """The registers of each set, as (sets, M)."""
    out = np.zeros((len(s.n), M), np.uint16)
    flat, low = out.reshape(-1), np.zeros(len(s.n), np.int64)
    unit, tok = np.repeat(np.arange(len(s.n)), s.n), s.tok
    seed = mix(tok ^ np.uint64(0xA0761D6478BD642F))
    scale = 1 / np.log(BASE)
    for j in range(M):
        if not len(tok):
            break
        share = (mix(tok + np.uint64(((j + 1) * 0xE7037ED1A0B428DB) % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        value = -np.log1p(-np.minimum((j + share) / M, 1 - 2.0**-53)) / RATE
        level = np.clip(np.floor(1 - np.log(np.maximum(value, 1e-300)) * scale), 0, _TOP).astype(np.int64)
        go = level > low[unit]
        unit, tok, seed, level = unit[go], tok[go], seed[go], level[go]
        np.maximum.at(flat, unit * M + _register(j, seed), level.astype(np.uint16))
        if j < 8 or j % 8 == 0:
            low = out.min(axis=1).astype(np.int64)
    return out


def _sketch_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in sets(batch.column("text"), False, k, 0):
                if not len(s.n):
                    continue
                flat = pa.py_buffer(sketches(s).tobytes())
                cols = [batch.column("id").take(pa.array(s.row)), pa.array(s.n), pa.array(s.sid), pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * M), len(s.n), [None, flat]).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "sid", "sketch"])

    return tidied(run)


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sid) of each band of each set."""
    for batch in batches:
        if batch.num_rows:
            own = _registers(batch.column("sketch"))[:, : M // ROWS * ROWS].reshape(batch.num_rows, -1, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(own.shape[1], dtype=np.uint64), own.shape[:2])
            for i in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, :, i])
            sid = np.repeat(batch.column("sid").to_numpy(), own.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(sid)], ["key", "sid"])


def estimate(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest Jaccard similarity of sets of n and m tokens by the registers in which the first is larger, smaller
    and equal, and a function that gives the log likelihood of any similarity. It has one peak, found by thirds."""
    u, v = n / (n + m), m / (n + m)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = chance(u - v * j), chance(v - u * j)
        parts = ((more, p), (less, q), (equal, 1 - p - q))
        return sum(np.where(c > 0, c * np.log(np.maximum(x, 1e-12)), 0.0) for c, x in parts)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(a) > likelihood(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2, likelihood


def _plausible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether pairs of sketches of sets of n and m tokens may be similar by num/den."""
    ok = (n * den >= m * num) & (m * den >= n * num)
    equal = np.count_nonzero(a == b, axis=1)
    share = num / den
    ok &= equal >= M * share - 8 * np.sqrt(M * share * (1 - share))  # far outside whatever the likelihood lets pass
    at = np.flatnonzero(ok)
    if len(at):
        more = np.count_nonzero(a[at] > b[at], axis=1)
        nn, mm = n[at].astype(np.float64), m[at].astype(np.float64)
        ok[at] = _near_enough(more, M - more - equal[at], equal[at], nn, mm, share)
    return ok


def _near_enough(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray, share: float) -> np.ndarray:
    """Whether the likeliest similarity reaches ``share``, or is likelier than it by a ratio of e^``SLACK`` at most. The
    likelihood has one peak: where the share of equal registers is likelier than the bound, the peak is on that side of it,
    and at least as high; it is searched for only where that does not tell."""
    _, likelihood = estimate(more, less, equal, n, m, 0)
    largest = np.minimum(n / m, m / n)
    bound, guess = np.minimum(share, largest), np.minimum(equal / M, largest)
    least, guessed = likelihood(bound) + SLACK, likelihood(guess)
    most = sum(c * np.log(np.maximum(c, 1) / M) for c in (more, less, equal))  # no similarity is likelier
    ok = (most <= least) | ((guess >= share) & (guessed > least - SLACK))
    at = np.flatnonzero(~ok & ((guess >= bound) | (guessed <= least)))
    if len(at):
        more, less, equal, n, m = (x[at] for x in (more, less, equal, n, m))
        best, likelihood = estimate(more, less, equal, n, m)
        ok[at] = (best >= share) | (likelihood(best) <= least[at])
    return ok


def _key_links(num: int, den: int):
    """Candidate links of keys (or of pairs of their blocks), as pairs of set ids that span them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for t in _by_key(batches, ("key", "i", "j")):
            key, bi, bj, sid, n = (t.column(c).to_numpy() for c in ("key", "i", "j", "sid", "n"))
            own = _registers(t.column("sketch"))
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]))
            length = np.diff(np.concatenate([edge, [len(key)]]))
            group, short = np.repeat(np.arange(len(edge)), length), np.repeat(length <= SHORT, length)
            out = []
            for step in range(1, min(SHORT, int(length.max()))):
                i = np.flatnonzero((group[step:] == group[:-step]) & short[step:])
                for lo in range(0, len(i), 1 << 14):
                    x = i[lo : lo + (1 << 14)]
                    ok = _plausible(own[x], own[x + step], n[x], n[x + step], num, den)
                    out.append(np.stack([sid[x[ok]], sid[x[ok] + step]]))
            for s, g in zip(edge[length > SHORT], length[length > SHORT]):
                out += _spanning(np.arange(s, s + g), own, n, sid, num, den)
            pairs = forest.new(np.unique(np.concatenate(out, axis=1), axis=1)) if out else []
            a, b = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tidied(run)


def _spanning(rest: np.ndarray, own: np.ndarray, n: np.ndarray, sid: np.ndarray, num: int, den: int) -> Iterator[np.ndarray]:
    """Links that span the candidates of one key: what a set reaches is reached once, so near copies cost one comparison
    each. A few sets that are reached look for the rest at once."""
    todo: list[int] = []
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
        some, todo = todo[-(at_once := max(_PAIRS // max(len(rest), 1), 1)) :], todo[:-at_once]
        for part in np.array_split(rest, len(rest) // _PAIRS + 1):
            x, y = np.repeat(some, len(part)), np.tile(part, len(some))
            near = _plausible(own[x], own[y], n[x], n[y], num, den).reshape(len(some), -1)
            reached = near.any(axis=0)
            if reached.any():
                by = np.asarray(some)[near[:, reached].argmax(axis=0)]
                yield np.stack([sid[by], sid[part[reached]]])
                todo += part[reached].tolist()
                rest = np.setdiff1d(rest, part[reached], assume_unique=True)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``: the smallest id reachable by links, and whether that
    is the row's own.

    Two texts link when the Jaccard similarity of their sets of ``shingle``-word shingles is num/den or more, judged on
    the full sets; candidates come from sketches (see above for the chance of a miss; num/den should be 0.7 or more). Words
    are runs of other than ASCII white space, ASCII letters in lower case; a shorter text is one shingle. Null, empty and
    blank texts have no shingles, no links, and stay. Repeated rows come back as often as they are given; a row of null id
    comes back with null component and null kept. Ids are whole numbers of up to 64 bits. An empty table gives an empty
    result. A long text is one step of a task, at about 60 bytes of memory a word. Other columns are ignored, whatever
    their names."""
    spark = docs.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = base.where("id is not null")
    seen = materialise(known.mapInArrow(_sketch_rows(shingle), "id long, n long, sid long, sketch binary"), "sketches")
    texts = seen.select("id", "n", "sid")
    # copies have the same sketch: any of them will do
    of_set = materialise(whole_sets(seen, F.first("sketch").alias("sketch")), "distinct")
    whole, of_set = of_set.drop("sketch"), of_set.select("sid", "n", "sketch")
    keys = of_set.select("sid", "sketch").mapInArrow(_bands, "key long, sid long")
    # near copies share most of their keys: of keys with the same sets (by count and two hashes) one is enough
    marks = F.count("*").alias("n_sets"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")
    shared = keys.groupBy("key").agg(*marks).where("n_sets > 1").groupBy("n_sets", "x", "y").agg(F.min("key").alias("key"))
    shared = shared.withColumn("nb", F.ceil(F.col("n_sets") / BLOCK).cast("long"))
    met = keys.join(shared.select("key", "nb"), "key").join(of_set, "sid")
    block = F.pmod(F.xxhash64("sid"), F.col("nb")).alias("own")
    met = met.select("key", "sid", "n", "sketch", block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("other"))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid", "n", "sketch")
    met = met.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = met.mapInArrow(_key_links(num, den), "a long, b long")
    classes = classes_of(known.select("id", "text"), whole, pairs, k=shingle, num=num, den=den)
    found = components(base, texts, classes, id_col)
    return found.withColumn("kept", F.col(id_col) == F.col("component_id"))
