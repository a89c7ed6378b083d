"""Exact Jaccard join of texts by their token sets, with set-relation skipping.

A text's set holds the hashes of its k-word shingles. The join runs in four Spark steps:

1. Size and identity (a hash of the sorted set) of every text, and counts of the frequent tokens. Equal sets are
   one class from here on, so exact copies cost nothing more.
2. An inverted index. Two sets with Jaccard >= t differ in at most D = (nx + ny)(1 - t)/(1 + t) tokens. A set is
   cut by token hash into k parts of about ``part`` tokens; in at least one part both differ by at most D/k, and
   there they share one of the D/k + 1 rarest tokens, at positions that add up to at most D/k. A list is cut into
   blocks by position, and a block meets only those blocks whose positions leave room; within blocks, entries are
   skipped by size and by the Hamming distance of parity bitmaps (a lower bound of the difference). No true link
   is lost. What a list gives are links that span its candidates, O(g) of g entries, never g^2. A list longer than
   ``LONG`` links its entries to a few leaders instead of to each other (triangle inequality).
3. Components of the candidate rows are families. Each class goes to its family's task once. In families larger
   than a block, every block meets the first one; what is one component by then is done, and only of the others
   all pairs of blocks are dealt out. Texts without a member are passed over by a Bloom filter of fixed size, so
   that only members' sets are shuffled.
4. ``_verify``: in a family, the overlaps of a set with all others are derived from those of the most
   similar set already answered, by the posting lists of the tokens in which the two differ. Once a family is
   one component, no further set is answered.

Token hashes are 48 bits wide: a pair of sets of n tokens is misjudged with a chance of about n^2/2^48.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, bloom_slots, connected_components, materialise, passes_bloom
from .token_sets import Sets, hamming, heavy_tokens, levels_of, mix, most_apart, order_of, parts_of, sets, tidied, unit_rows

#: Index lists up to ``SHORT`` compare all neighbours at once, up to ``LONG`` block by block; longer ones use leaders.
SHORT, LONG = 24, 512
#: Most sets, and most tokens, of one block of a family.
BLOCK_SETS, BLOCK_TOKENS = 512, 250_000


def _index_rows(k: int, num: int, den: int, part: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in sets(batch.column("text"), False, k, 0):
                yield from emit(s)

    def emit(s: Sets) -> Iterator[pa.RecordBatch]:
        first = np.zeros(len(s.n), bool)
        first[np.unique(s.sid, return_index=True)[1]] = True  # copies within a batch need one entry
        first &= s.n > 0
        tok, n, sid = s.tok[np.repeat(first, s.n)], s.n[first], s.sid[first]
        if not len(n):
            return
        unit = np.repeat(np.arange(len(n)), n)
        rare = levels_of(tok, heavy.value)
        k_own, k_low = parts_of(n, part), parts_of((n * num + den - 1) // den, part)
        yield from one(tok, unit, rare, n, sid, k_own, np.ones(len(n), bool))
        if (low := k_low != k_own).any():
            yield from one(tok, unit, rare, n, sid, k_low, low)

    def one(tok, unit, rare, n, sid, parts, on) -> Iterator[pa.RecordBatch]:
        if not on.all():
            keep = on[unit]
            renum = np.cumsum(on) - 1
            tok, unit, rare, n, sid, parts = tok[keep], renum[unit[keep]], rare[keep], n[on], sid[on], parts[on]
        base = np.concatenate([[0], np.cumsum(parts)])
        seg = base[unit] + ((tok >> np.uint64(17)).astype(np.int64) & (parts[unit] - 1))
        owner = np.repeat(np.arange(len(n)), parts)
        size = np.bincount(seg, minlength=base[-1])
        apart = most_apart(n, num, den)[owner] // parts[owner]
        order = order_of((seg << 5) | rare)  # tokens of a unit come in order already
        tok, seg = tok[order], seg[order]
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        pos = np.arange(len(tok)) - start[seg]
        full = size > 0
        bits = np.zeros(base[-1], np.uint64)
        bits[full] = np.bitwise_xor.reduceat(np.uint64(1) << (tok & np.uint64(63)), start[full])
        # a whole set lacks at most (1 - t) of its tokens in its partner
        keep = pos <= np.where(parts[owner] == 1, np.minimum(apart, n[owner] - (n[owner] * num + den - 1) // den), apart)[seg]
        tok, seg, pos = tok[keep], seg[keep], pos[keep]
        key = mix(tok + parts[owner[seg]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bare = np.flatnonzero((parts[owner] > 1) & (size <= 2 * apart))  # parts too small to share a token
        if len(bare):
            which = (bare - base[owner[bare]]).astype(np.uint64)
            key = np.concatenate([key, mix(mix(which + np.uint64(77)) + parts[owner[bare]].astype(np.uint64))])
            seg, pos = np.concatenate([seg, bare]), np.concatenate([pos, np.zeros(len(bare), np.int64)])
        own = owner[seg]
        meta = (n[own] << 24) | (apart[seg] << 12) | pos
        cols = [key.view(np.int64), sid[own], bits[seg].view(np.int64), meta]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "sid", "bits", "meta"])

    return tidied(run)


def _by_key(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Batches of a sorted partition, cut where the key changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows - 1, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            same &= v[1:] == v[:-1]
        cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        if held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    """Keeps a task's links to those that join what it had not joined before (bounded; starts anew when full)."""

    def __init__(self, most: int = 1 << 20):
        self.up: dict[int, int] = {}
        self.most = most

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def new(self, pairs: np.ndarray) -> list[tuple[int, int]]:
        if len(self.up) > self.most:
            self.up.clear()
        out = []
        for x, y in zip(*pairs.tolist()):
            a, b = self.find(x), self.find(y)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.up.setdefault(min(a, b), min(a, b))
                out.append((x, y))
        return out


def _list_links(num: int, den: int):
    """Links within the index lists of a sorted partition, as pairs of set ids that span what it links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for t in _by_key(batches, ("key",)):
            key, sid, bits, meta = (t.column(c).to_numpy() for c in ("key", "sid", "bits", "meta"))
            bits = bits.view(np.uint64)
            n, apart, pos = meta >> 24, (meta >> 12) & 4095, meta & 4095
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            length = np.diff(np.concatenate([edge, [len(key)]]))
            in_short = np.repeat(length <= SHORT, length)
            out = []
            for step in range(1, min(SHORT, int(length.max()))):
                i = np.flatnonzero((key[step:] == key[:-step]) & in_short[step:])
                if not len(i):
                    break
                j = i + step
                ok = (n[i] * den >= n[j] * num) & (pos[i] + pos[j] <= apart[i]) & (sid[i] != sid[j])
                i, j = i[ok], j[ok]
                ok = hamming(bits[i], bits[j]) <= apart[i]
                out.append(np.stack([sid[i[ok]], sid[j[ok]]]))
            for s, g in zip(edge[length > SHORT], length[length > SHORT]):
                of = slice(s, s + g)
                if g <= LONG:
                    out += _blocks(sid[of], bits[of], n[of], apart[of], pos[of], num, den)
                else:
                    out.append(_leaders(sid[of], bits[of], n[of], apart[of], num, den))
            pairs = forest.new(np.unique(np.concatenate(out, axis=1), axis=1)) if out else []
            a, b = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tidied(run)


def _blocks(sid, bits, n, apart, pos, num, den) -> Iterator[np.ndarray]:
    """Entries come by size. A block holds those of one position; blocks whose positions add up to more than any
    entry may be apart are skipped, and of the others each entry meets those of fitting size."""
    blocks = {p: np.flatnonzero(pos == p) for p in np.unique(pos).tolist()}
    most = int(apart.max())
    for p, own in blocks.items():
        for q, other in blocks.items():
            if q < p or p + q > most:
                continue
            lo, hi = np.searchsorted(n[other], [-(-n[own] * num // den), n[own] * den // num + 1])
            width = hi - lo
            i = np.repeat(own, width)
            j = other[np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo, width)]
            least = np.minimum(apart[i], apart[j])
            ok = (p + q <= least) & (sid[i] != sid[j])
            i, j, least = i[ok], j[ok], least[ok]
            ok = hamming(bits[i], bits[j]) <= least
            yield np.stack([sid[i[ok]], sid[j[ok]]])


def _leaders(sid, bits, n, apart, num, den) -> np.ndarray:
    """Entries come by size. Each is linked to all leaders within reach, and leads where none is near.

    If x is near a leader (similar in size, distance at most its own bound) and y links with x, then y is
    within the sum of both bounds of that leader, so x and y meet in it."""
    pairs, todo = [], np.arange(len(sid))
    while len(todo):  # one vectorised pass over the entries of fitting size for each leader
        lead = todo[0]
        size = n[lead]
        lo, hi = np.searchsorted(n, [size * num * num // (den * den), size * den * den // (num * num) + 2])
        rest = slice(lo, hi)
        dist = hamming(bits[rest], bits[lead])
        reach = sid[rest][dist <= apart[rest] + apart[rest] * den // num + 2]
        reach = reach[reach != sid[lead]]
        pairs.append(np.stack([np.full(len(reach), sid[lead]), reach]))
        near = np.zeros(len(sid), bool)
        near[rest] = (dist <= apart[rest]) & (n[rest] * den >= size * num) & (n[rest] * num <= size * den)
        near[lead] = True
        todo = todo[~near[todo]]
    return np.concatenate(pairs, axis=1)


def _member_sets(k: int, passing):
    """Texts to (id, sid, tokens) of those that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes_bloom(passing.value, bloom_slots(batch.column("id").to_numpy()))))
            for s in sets(batch.column("text"), False, k, 0):
                offsets = pa.array(np.concatenate([[0], np.cumsum(s.n) * 8]).astype(np.int32))
                tokens = pa.BinaryArray.from_buffers(pa.binary(), len(s.n), [None, offsets.buffers()[1], pa.py_buffer(s.tok.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(s.row)), pa.array(s.sid), tokens], ["id", "sid", "tokens"])

    return tidied(run)


def _answers(own_sets: list[np.ndarray], num: int, den: int, cross: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the indices of the sets it links with (of the other block, where ``cross`` tells
    the blocks apart). Sets are answered in turn from the nearest answered one."""
    g = len(own_sets)
    n = np.array([len(s) for s in own_sets], np.int64)
    flat = np.concatenate(own_sets)
    owner = np.repeat(np.arange(g, dtype=np.int32), n)
    order = np.argsort(flat, kind="stable")  # lists by token; within a list by index, that is by size
    toks, owner = flat[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], toks[1:] != toks[:-1]]))
    vocab, ends = toks[head], np.concatenate([head[1:], [len(toks)]])
    ids = np.empty(len(flat), np.int64)
    ids[order] = np.repeat(np.arange(len(vocab)), ends - head)
    cut = np.concatenate([[0], np.cumsum(n)])
    own = [np.sort(ids[cut[i] : cut[i + 1]]) for i in range(g)]

    def add(which: np.ndarray) -> np.ndarray:
        length = ends[which] - head[which]
        if not len(which):
            return np.zeros(g, np.int64)
        at = np.repeat(head[which] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        return np.bincount(owner[at], minlength=g)

    best, best_of, rows = np.zeros(g, np.int64), np.full(g, -1), {}
    for i in range(g):
        if best_of[i] >= 0 and 2 * best[i] >= n[i]:  # an answered set shares at least half of it
            p = best_of[i]
            new, gone = np.setdiff1d(own[i], own[p], assume_unique=True), np.setdiff1d(own[p], own[i], assume_unique=True)
            row = rows[p] + add(new) - add(gone)
        else:
            row = add(own[i])
        rows[i] = row.astype(np.int32)
        better = row > best
        best[better], best_of[better] = row[better], i
        both = den * row >= num * (n + n[i] - row)
        both[i] = False
        if cross is not None:
            both &= cross != cross[i]
        yield i, np.flatnonzero(both)


def _verify(num: int, den: int, across: bool = False):
    """Families (or pairs of their blocks) to (sid, label): the smallest set id linked within them; ``across`` looks for
    links between two blocks only. A set that repeated rows give more than once comes back once. What has become one
    component asks no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ("fam", "i", "j")):
            fam, bi, bj, sid, own = (t.column(c).to_numpy() for c in ("fam", "i", "j", "sid", "own"))
            tokens = t.column("tokens")
            edge = np.flatnonzero(np.concatenate([[True], (fam[1:] != fam[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]))
            label = sid.copy()
            once = np.ones(len(sid), bool)
            for s, e in zip(edge, [*edge[1:], len(sid)]):
                if e - s < 2:
                    continue
                once[s + 1 : e] = sid[s + 1 : e] != sid[s : e - 1]
                at = s + np.flatnonzero(once[s:e])  # by sid; a repeated row gives the same set again
                own_sets = [np.frombuffer(tokens[int(x)].as_py(), np.uint64) for x in at]
                at = at[by_size := np.argsort([len(x) for x in own_sets], kind="stable")]
                cross = own[at] if across else None
                top, left = np.arange(len(at)), len(at)
                for x, linked in _answers([own_sets[y] for y in by_size], num, den, cross):
                    if len(others := np.setdiff1d(top[linked], top[x])):
                        top[np.isin(top, others)] = top[x]
                        left -= len(others)
                        if left == 1:
                            break
                low = np.full(len(at), np.iinfo(np.int64).max)
                np.minimum.at(low, top, sid[at])
                label[at] = low[top]
            yield pa.RecordBatch.from_arrays([pa.array(sid[once]), pa.array(label[once])], ["sid", "label"])

    return tidied(run)


def classes_of(docs: DataFrame, whole: DataFrame, pairs: DataFrame, *, k: int, num: int, den: int) -> DataFrame:
    """(sid, id0, copies, label) of each distinct set of ``whole(sid, id, copies, n)``: the smallest sid reachable by true
    links. ``pairs(a, b)`` are candidate links whose components, the families, hold every true link."""
    spark = docs.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    pairs = materialise(pairs.distinct(), "candidates")
    family = connected_components(pairs)
    member = whole.join(family.select(F.col("node").alias("sid"), F.col("label").alias("fam")), "sid")
    size = member.groupBy("fam").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).cast("long").alias("nb"))
    member = materialise(member.join(size, "fam"), "members")
    passing = spark.sparkContext.broadcast(bloom_filter(member, "id"))
    of_sets = docs.mapInArrow(_member_sets(k, passing), "id long, sid long, tokens binary").join(member, ["sid", "id"])

    of_sets = of_sets.select("fam", "nb", "sid", "tokens", F.pmod(F.xxhash64("sid"), F.col("nb")).alias("own"))

    def compared(rows: DataFrame, others: Column, across: bool = False) -> DataFrame:
        """Members, each in the blocks that it forms with those of ``others``."""
        dealt = rows.select("fam", "sid", "tokens", "own", F.explode(others).alias("other"))
        dealt = dealt.select("fam", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid", "own", "tokens")
        dealt = dealt.repartition(width, "fam", "i", "j").sortWithinPartitions("fam", "i", "j", "sid")
        return dealt.mapInArrow(_verify(num, den, across), "sid long, label long")

    zero, one, last = F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("nb") - 1
    if member.where("nb > 1").limit(1).count():
        of_sets = materialise(of_sets.dropDuplicates(["sid"]), "sets")
        large = of_sets.where("nb > 1")
        # each block meets the first one, links within it included: two token lists a member
        first = materialise(compared(large, F.when(F.col("own") == 0, F.sequence(one, last)).otherwise(F.array(zero))), "first")
        label = materialise(connected_components(first, "sid", "label").select(F.col("node").alias("sid"), "label"), "labels")
        known = large.select("fam", "nb", "sid").join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        open_ = known.groupBy("fam").agg((F.min("label") != F.max("label")).alias("open"), F.max("nb").alias("nb")).where("open and nb > 2").select("fam")
        if open_.limit(1).count():  # families that are not one component by now: all other pairs of blocks
            rest = large.where("own > 0").join(open_, "fam", "left_semi")
            more = compared(rest, F.filter(F.sequence(one, last), lambda j: j != F.col("own")), True)
            links = materialise(more.union(label.select("sid", "label")), "links")
            label = connected_components(links, "sid", "label").select(F.col("node").alias("sid"), "label")
        found = label.union(compared(of_sets.where("nb = 1"), F.array(zero)))
    else:
        found = compared(of_sets, F.array(zero))
    found = whole.join(found, "sid", "left").select("sid", F.col("id").alias("id0"), "copies", F.coalesce("label", "sid").alias("label"))
    return materialise(found, "classes")


def components(docs: DataFrame, texts: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """(id_col, n_shingles, component_id) of each row of ``docs(id, text)``: from its set's class, or by itself."""
    root = classes.groupBy("label").agg(F.min("id0").alias("component_id"))
    of_set = classes.join(root, "label").select("sid", "component_id")
    found = texts.join(of_set, "sid", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    none = docs.where("id is null or text is null").select("id", F.lit(0).cast("long"), "id")
    return found.union(none).withColumnRenamed("id", id_col)


def whole_sets(texts: DataFrame, *more: Column) -> DataFrame:
    """(sid, id, copies, n) and what else is asked for: each distinct set that is not empty, under the smallest id of its texts."""
    return texts.where("n > 0").groupBy("sid").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), *more)


def similarity_classes(docs: DataFrame, *, k: int, num: int, den: int, part: int) -> tuple[DataFrame, DataFrame]:
    """Join the texts of ``docs(id, text)`` at Jaccard >= num/den.

    Returns two written tables: texts (id, n, sid) with one row for each text that is not null, and classes (sid,
    id0, copies, label): for each distinct non-empty set, the smallest id of its texts, their number, and the smallest
    sid reachable by links. Ids are whole numbers."""
    spark = docs.sparkSession
    docs = docs.select("id", "text")
    seen = materialise(docs.mapInArrow(unit_rows(k, False, 0), "id long, unit long, n long, sid long"), "texts")
    texts = seen.where("unit is not null").select("id", "n", "sid")
    heavy = spark.sparkContext.broadcast(heavy_tokens(seen.where("unit is null")))

    index = docs.mapInArrow(_index_rows(k, num, den, part, heavy), "key long, sid long, bits long, meta long")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    lists = index.repartition(width, "key").sortWithinPartitions("key", "meta")
    pairs = lists.mapInArrow(_list_links(num, den), "a long, b long")
    return texts, classes_of(docs, whole_sets(texts), pairs, k=k, num=num, den=den)
