"""Operator 5: near-duplicate lines by an exact set-similarity join; later matches go.

1. Each line gets its size and the hash of its token set; equal sets are one class from here on.
2. Prefix index: a set's tokens are ordered by rarity. Two sets of n and m tokens with Jaccard >= t differ in at
   most D = (n + m)(1 - t)/(1 + t) tokens, so they share one of the rarest few, at positions that add up to at
   most D. Sets of more than ``PART`` tokens are cut into parts by token hash; in one part both differ by D/k at
   most. Within the list of a token, entries are passed over by length, by position and by the Hamming distance
   of parity bitmaps (a lower bound of the difference). A token of more than ``COMMON`` lines has no list: two
   sets whose rarest shared token is common also share the next one, within one place more, and meet in the list
   of both. No true link is lost.
3. In a list a line does not name all its candidates: ``FEW`` that are surely near are enough, and in a list longer
   than ``SHORT`` it names ``MANY`` at most. It is then noted down as cut short, and if no candidate turns out to
   match, it alone is taken through its lists again, without a limit.
4. Candidates are verified on the token sets, the nearest of each line first. The others are met, and their places
   looked up, only where that fails: one earlier match is enough for a line to go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bloom_filter, bloom_slots, free_name, materialise, passes_bloom
from .token_sets import TOKEN_BITS, Sets, hamming, heavy_tokens, levels_of, mix, most_apart, order_of, parts_of, sets, tidied, unit_rows

#: Tokens of a part of a long line's set.
PART = 64
#: Tokens of more lines than 2^COMMON_LEVEL have no lists of their own.
COMMON_LEVEL = 12
#: Lists up to this length are compared at once.
SHORT = 128
#: Candidates that a line names in a list: of those surely near, and in a longer list of others.
FEW, MANY = 2, 256
#: Texts of up to so many lines are picked by a broadcast of their ids (8 bytes each).
MOST_SENT = 100_000
#: Entries of a long list that are compared in one step, and entries of short lists.
_ROWS, _COLUMNS, _STEP = 256, 1024, 50_000
#: Entries that a worker packs at once.
_PACKED = 200_000
#: Parts of the index for each shuffle partition: a worker holds one part at a time.
GROUPS = 16
#: Bits of a key that tell the size of a set.
SIZE_BITS = 20
_SIZE = np.uint64((1 << SIZE_BITS) - 1)


def _entries(num: int, den: int, least: int, heavy, groups: int):
    """Texts to index entries (key, sid, id, bits, meta). The last SIZE_BITS of a key are the set's size, so that one
    sort gives lists in the order of sizes (two tokens of one key share a list, which costs time only); meta packs
    the size, the log of the number of parts, and the token's position.

    Entries travel in blocks (part, block): those of a batch whose keys fall in one of ``groups`` parts, column after
    column, since rows of five numbers each cost several times what their bytes cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            some, n = [], 0
            for s in sets(batch.column("text"), True, 1, least):
                for e in emit(s, ids[s.row]):
                    some.append(e)
                    n += e.shape[1]
                if n > _PACKED:
                    yield packed(some)
                    some, n = [], 0
            if some:
                yield packed(some)

    def packed(some: list[np.ndarray]) -> pa.RecordBatch:
        entries = np.concatenate(some, axis=1)
        part = (mix((entries[0] >> SIZE_BITS).view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = order_of(part)
        entries, part = entries[:, order], part[order]
        edge = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        blocks = [entries[:, a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), pa.array(blocks, pa.binary())], ["part", "block"])

    def emit(s: Sets, ids: np.ndarray) -> Iterator[np.ndarray]:
        use = np.zeros(len(s.n), bool)
        use[firsts(s.sid, ids)] = True  # copies within a batch need one entry, that of the smallest id
        use &= most_apart(s.n, num, den) > 0  # smaller sets match equal ones only
        tok, n, sid, ids = s.tok[np.repeat(use, s.n)], s.n[use], s.sid[use], ids[use]
        if not len(n):
            return
        unit = np.repeat(np.arange(len(n)), n)
        level = levels_of(tok, heavy.value)
        own, low = parts_of(n, PART), parts_of((n * num + den - 1) // den, PART)
        yield one(tok, unit, level, n, sid, ids, own)
        if (on := low != own).any():  # a smaller partner may be cut into fewer parts
            at = on[unit]
            yield one(tok[at], (np.cumsum(on) - 1)[unit[at]], level[at], n[on], sid[on], ids[on], low[on])

    def one(tok, unit, level, n, sid, ids, parts) -> np.ndarray:
        base = np.concatenate([[0], np.cumsum(parts)])
        seg = base[unit] + ((tok >> np.uint64(17)).astype(np.int64) & (parts[unit] - 1))
        owner = np.repeat(np.arange(len(n)), parts)
        size = np.bincount(seg, minlength=base[-1])
        order = order_of((seg << 5) | level)  # tokens of a unit come in order already
        tok, seg, level = tok[order], seg[order], level[order]
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        pos = np.arange(len(tok)) - start[seg]
        full = size > 0
        bits = np.zeros(base[-1], np.uint64)
        bits[full] = np.bitwise_xor.reduceat(np.uint64(1) << (tok & np.uint64(63)), start[full])
        apart = most_apart(n, num, den)[owner] // parts[owner]
        # a whole set lacks at most (1 - t) of its tokens in its partner
        last = np.where(parts[owner] == 1, np.minimum(apart, n[owner] - (n[owner] * num + den - 1) // den), apart)[seg]
        scheme = mix(parts[owner[seg]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        common = level > COMMON_LEVEL
        at = np.flatnonzero((pos <= last) & ~common)
        keys, segs, places = [mix(tok[at] + scheme[at])], [seg[at]], [pos[at]]
        some = np.flatnonzero((pos <= last + 1) & common)
        for step in range(1, len(some)):  # pairs of common tokens of one part
            a, b = some[:-step], some[step:]
            same = seg[a] == seg[b]
            if not same.any():
                break
            a, b = a[same], b[same]
            keys.append(mix(mix(tok[a] + scheme[a]) + tok[b])), segs.append(seg[a]), places.append(pos[b] - 1)
        bare = np.flatnonzero((parts[owner] > 1) & (size <= 2 * apart + 2))  # parts too small to share tokens
        if len(bare):
            which = (bare - base[owner[bare]]).astype(np.uint64)
            band = np.floor(np.log(n[owner[bare]]) / np.log(1.001 * den / num)).astype(np.int64)
            for b in (band, band - 1):  # sizes of a link are in one band or in neighbouring ones
                keys.append(mix(mix(which + np.uint64(77)) + mix(b.astype(np.uint64)) + parts[owner[bare]].astype(np.uint64)))
                segs.append(bare), places.append(np.zeros(len(bare), np.int64))
        key, seg, pos = map(np.concatenate, (keys, segs, places))
        at = owner[seg]
        meta = (n[at] << 24) | (np.log2(parts[at]).astype(np.int64) << 16) | np.minimum(pos, 65535)
        sized = (key & ~_SIZE) | np.minimum(n[at], int(_SIZE)).astype(np.uint64)
        return np.stack([sized.view(np.int64), sid[at], ids[at], bits[seg].view(np.int64), meta])

    return tidied(run)


_ENTRY = ["key", "sid", "id", "bits", "meta"]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Blocks that come by part to the columns of each part, its lists in order."""
    held, last = [], None

    def columns() -> dict[str, np.ndarray]:
        entries = np.concatenate([np.frombuffer(b, np.int64).reshape(5, -1) for b in held], axis=1)
        c = dict(zip(_ENTRY, entries[:, np.argsort(entries[0])]))
        return c | {"key": c["key"] >> SIZE_BITS}

    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("block")):
            if held and part != last:
                yield columns()
                held = []
            held.append(block.as_py())
            last = part
    if held:
        yield columns()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of a sorted partition, some batches at once, cut where the list changes; a list comes whole."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < _STEP or held[0].column("key")[0].as_py() >> SIZE_BITS == batch.column("key")[batch.num_rows - 1].as_py() >> SIZE_BITS:
            continue
        c = _columns(held)
        change = np.flatnonzero(c["key"][1:] != c["key"][:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield {k: v[:cut] for k, v in c.items()}
            held, rows = [pa.Table.from_batches(held).slice(cut).combine_chunks().to_batches()[0]], rows - cut
    if rows:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(batches)
    c = {c: t.column(c).to_numpy() for c in t.column_names}
    return c | {"key": c["key"] >> SIZE_BITS}


def firsts(sid: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where each set stands first, by id."""
    order = np.lexsort((ids, sid))
    return order[np.concatenate([[True], sid[order][1:] != sid[order][:-1]])] if len(order) else order


_FOUND = ["a", "b", "far", "bits", "meta"]


def _candidates(num: int, den: int, again: bool):
    """Lists to pairs (a, b, far) of set ids, b of a smaller id than a (of one id: both ways), with the distance of their
    bitmaps; (a, a) notes that a was cut short. The entries of such lists come back too, as (sid, id, key, bits, meta), so that they need not be made a
    second time; in pairs meta is null. ``again`` is that second time: only entries that ask name candidates."""

    def bound(n, m, logp):
        return ((n + m) * (den - num) // (den + num)) >> logp

    def long(c: dict[str, np.ndarray], few: int, many: int) -> Iterator[np.ndarray]:
        at = firsts(c["sid"], c["id"])
        at = at[np.argsort(c["id"][at], kind="stable")]
        sid, id_, bits, n, logp, pos = (c[x][at] for x in ("sid", "id", "bits", "n", "logp", "pos"))
        asks = c["ask"][at] if again else np.ones(len(at), bool)
        for lo in range(0, len(at), _ROWS):
            rows = lo + np.flatnonzero(asks[lo : lo + _ROWS])
            left = 0
            while len(rows) and left < (end := int(np.searchsorted(id_, id_[rows[-1]], "right"))):  # of one id: all
                cols = np.arange(left, min(left + _COLUMNS, end))
                left += _COLUMNS
                r = rows[:, None]
                most = bound(n[r], n[cols], logp[r])
                far = hamming(bits[r], bits[cols])
                ok = (far <= most) & (pos[r] + pos[cols] <= most) & (id_[cols] <= id_[r]) & (cols != r) & (n[r] * den >= n[cols] * num) & (n[cols] * den >= n[r] * num)
                i, j = np.nonzero(ok)
                far, sure = far[i, j], 2 * far[i, j] <= most[i, j]
                by = np.lexsort((far, i))
                i, j, far, sure = i[by], j[by], far[by], sure[by]
                all_, near = np.bincount(i, minlength=len(rows)), np.bincount(i, sure, minlength=len(rows))
                most_named = np.where(near >= few, few, many)
                named = np.arange(len(i)) - (np.cumsum(all_) - all_)[i] < most_named[i]
                yield np.stack([sid[rows[i[named]]], sid[cols[j[named]]], far[named]])
                done = (near >= few) | (all_ >= many)
                short = sid[rows[done & ((all_ > most_named) | (left < end))]]
                yield np.stack([short, short, np.zeros_like(short)])
                rows = rows[~done]

    def enough(logp):
        """How many surely near candidates are enough: more of a set that is cut into parts, since a part says less."""
        return FEW << (logp > 0)

    def nearest(pairs: np.ndarray, key: np.ndarray, sid: np.ndarray, ids: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (x, y, far, most) of entries as (later, earlier, far) by id, of one id both ways; of an entry's pairs the
        nearest if enough are surely near. And the entries that were cut short. Of copies in a list only the first
        counts: what one of them meets, all do."""
        at = np.unique(pairs[:2])
        at = at[np.lexsort((ids[at], sid[at], key[at]))]
        first = np.zeros(len(key), bool)
        first[at] = np.concatenate([[True], (sid[at][1:] != sid[at][:-1]) | (key[at][1:] != key[at][:-1])])[: len(at)]
        x, y, far, most = pairs[:, first[pairs[0]] & first[pairs[1]]]
        same = ids[x] == ids[y]
        later, earlier = np.where(ids[x] > ids[y], x, y), np.where(ids[x] > ids[y], y, x)
        later, earlier = np.concatenate([later, earlier[same]]), np.concatenate([earlier, later[same]])
        far, most = np.concatenate([far, far[same]]), np.concatenate([most, most[same]])
        by = np.lexsort((far, later))
        later, earlier, far, most = later[by], earlier[by], far[by], most[by]
        edge = np.flatnonzero(np.concatenate([[True], later[1:] != later[:-1]])) if len(later) else np.empty(0, np.int64)
        size = np.diff(np.concatenate([edge, [len(later)]]))
        sure = np.add.reduceat((2 * far <= most).astype(np.int64), edge) if len(edge) else edge
        few = enough(logp[later[edge]])
        named = np.where(sure >= few, np.minimum(few, size), size)
        keep = np.arange(len(later)) - np.repeat(edge, size) < np.repeat(named, size)
        return np.stack([later[keep], earlier[keep], far[keep]]), later[edge[size > named]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _lists(batches) if again else _unpacked(batches):
            key, meta = c["key"], c["meta"]
            c |= {"bits": c["bits"].view(np.uint64), "n": meta >> 24, "logp": (meta >> 16) & 255, "pos": meta & 65535}
            sid, n, pos, bits, logp = (c[x] for x in ("sid", "n", "pos", "bits", "logp"))
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            length = np.diff(np.concatenate([edge, [len(key)]]))
            out, cut_short = [], np.zeros(len(key), bool)
            if not again:
                near = []
                i = np.flatnonzero(np.repeat((length > 1) & (length <= SHORT), length))
                for step in range(1, SHORT):
                    i = i[i + step < len(key)]
                    i = i[(key[i + step] == key[i]) & (n[i] * den >= n[i + step] * num)]  # entries come by size
                    if not len(i):
                        break
                    j = i + step
                    most = bound(n[i], n[j], logp[i])
                    ok = (pos[i] + pos[j] <= most) & (sid[i] != sid[j])
                    x, y, most = i[ok], j[ok], most[ok]
                    far = hamming(bits[x], bits[y])
                    ok = far <= most
                    near.append(np.stack([x[ok], y[ok], far[ok], most[ok]]))
                if near:
                    pairs, short = nearest(np.concatenate(near, axis=1), key, sid, c["id"], logp)
                    lists = np.cumsum(np.isin(np.arange(len(key)), edge)) - 1
                    out += [np.stack([sid[pairs[0]], sid[pairs[1]], pairs[2]]), np.stack([sid[short], sid[short], np.zeros_like(short)])]
                    cut_short = np.isin(lists, lists[short])
            by_blocks = length > (1 if again else SHORT)
            for s, g in zip(edge[by_blocks], length[by_blocks]):
                part = {k: v[s : s + g] for k, v in c.items()}
                every = len(key) + 1
                found = list(long(part, *((every, every) if again else (enough(part["logp"].max()), MANY))))
                cut_short[s : s + g] = any((x[0] == x[1]).any() for x in found)
                out += found
            found = np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)
            if found.shape[1]:
                found = found[:, np.lexsort(found[::-1])]
                found = found[:, np.concatenate([[True], (found[:2, 1:] != found[:2, :-1]).any(axis=0)])]
            none = pa.nulls(found.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in found), none, none], _FOUND)
            if cut_short.any() and not again:
                of = cut_short
                cols = [sid[of], c["id"][of], key[of], bits[of].view(np.int64), meta[of]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], _FOUND)

    return tidied(run)


def _member_sets(least: int, passing):
    """Texts to (id, unit, sid, tokens) of the lines that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes_bloom(passing.value, bloom_slots(batch.column("id").to_numpy()))))
            ids = batch.column("id").to_numpy()
            wanted = lambda row, no, ids=ids: passes_bloom(passing.value, bloom_slots(ids[row], no))
            for s in sets(batch.column("text"), True, 1, least, wanted):
                offsets = pa.array(np.concatenate([[0], np.cumsum(s.n) * 8]).astype(np.int32))
                tokens = pa.BinaryArray.from_buffers(pa.binary(), len(s.n), [None, offsets.buffers()[1], pa.py_buffer(s.tok.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(ids[s.row]), pa.array(s.no), pa.array(s.sid), tokens], ["id", "unit", "sid", "tokens"])

    return tidied(run)


def _matching(num: int, den: int):
    """Rows (x, y, tx, ty) of lines and their token sets to the x and y that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                keys, sizes = [], []
                for c in ("tx", "ty"):
                    tokens = part.column(c).to_pylist()
                    n = np.array([len(t) // 8 for t in tokens], np.int64)
                    row = np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(TOKEN_BITS)
                    keys.append(row | np.frombuffer(b"".join(tokens), np.uint64)), sizes.append(n)
                at = np.searchsorted(keys[0], keys[1])
                hit = keys[0][np.minimum(at, len(keys[0]) - 1)] == keys[1] if len(keys[0]) else np.zeros(len(keys[1]), bool)
                both = np.bincount((keys[1][hit] >> np.uint64(TOKEN_BITS)).astype(np.int64), minlength=part.num_rows)
                yield part.select(["x", "y"]).filter(pa.array(den * both >= num * (sizes[0] + sizes[1] - both)))

    return tidied(run)


def _place(id_: str, unit: str) -> Column:
    """Ids of 64 bits and line numbers as one number in their order."""
    return F.col(id_).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(unit).cast("decimal(10,0)")


def later_matches(docs: DataFrame, num: int, den: int, least: int) -> DataFrame:
    """(id, unit) of the lines of ``docs(id, text)`` that match an earlier one."""
    spark = docs.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    seen = materialise(docs.mapInArrow(unit_rows(1, True, least), "id long, unit long, n long, sid long"), "lines")
    units = seen.where("unit is not null")
    heavy = spark.sparkContext.broadcast(heavy_tokens(seen.where("unit is null")))
    whole = units.groupBy("sid").agg(F.min(_place("id", "unit")).alias("place"), F.count("*").alias("copies"))
    whole = materialise(whole, "classes")
    index = docs.mapInArrow(_entries(num, den, least, heavy, GROUPS * width), "part long, block binary")

    def candidates(lists: DataFrame, again: bool) -> tuple[DataFrame, DataFrame]:
        found = materialise(lists.mapInArrow(_candidates(num, den, again), ", ".join(f"{c} long" for c in _FOUND)), "lists")
        pairs = found.where("meta is null").groupBy("a", "b").agg(F.min("far").alias("far"))
        entries = found.where("meta is not null").select(F.shiftleft("far", SIZE_BITS).alias("key"), F.col("a").alias("sid"), F.col("b").alias("id"), "bits", "meta")
        return materialise(pairs, "candidates"), entries

    def matched(pairs: DataFrame) -> DataFrame:
        """The later sid of each pair that matches."""
        node = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        unit = F.pmod("place", F.lit(1 << 31).cast("decimal(10,0)"))
        id_ = ((F.col("place") - unit) / F.lit(1 << 31).cast("decimal(10,0)")).cast("long")
        member = materialise(node.join(whole, "sid").select("sid", "place", id_.alias("id"), unit.cast("long").alias("unit")), "members")
        passing = spark.sparkContext.broadcast(bloom_filter(member, "id", "unit"))
        texts = docs.join(F.broadcast(member.select("id").distinct()), "id", "left_semi") if member.count() <= MOST_SENT else docs
        of_sets = texts.mapInArrow(_member_sets(least, passing), "id long, unit long, sid long, tokens binary")
        of_sets = materialise(of_sets.join(member, ["sid", "id", "unit"]).select("sid", "place", "tokens"), "sets")

        def verified(pairs: DataFrame) -> DataFrame:
            """Each x that matches its y, which must come earlier: pairs of one id stand there both ways."""
            x, y = (of_sets.select(F.col("sid").alias(c), F.col("place").alias(f"p{c}"), F.col("tokens").alias(f"t{c}")) for c in "xy")
            met = pairs.join(x, "x").join(y, "y").where("px > py").select("x", "y", "tx", "ty")
            return materialise(met.mapInArrow(_matching(num, den), "x long, y long").select(F.col("x").alias("sid")).distinct(), "matched")

        pairs = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "far")
        nearest = materialise(pairs.groupBy("x").agg(F.min_by("y", "far").alias("y")), "nearest")
        first = verified(nearest)
        rest = pairs.join(first, F.col("x") == F.col("sid"), "left_anti").join(nearest, ["x", "y"], "left_anti")
        return first.union(verified(rest.select("x", "y")))

    pairs, long = candidates(index.repartition(width, "part").sortWithinPartitions("part"), False)
    gone = matched(pairs.where("a <> b"))
    asking = pairs.where("a = b").select(F.col("a").alias("sid")).join(gone, "sid", "left_anti")
    asking = materialise(asking.withColumn("ask", F.lit(True)), "asking")
    if asking.limit(1).count():
        more = long.join(asking, "sid", "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
        more = more.repartition(width, F.shiftright("key", SIZE_BITS)).sortWithinPartitions("key")
        gone = gone.union(matched(candidates(more, True)[0].where("a <> b"))).distinct()
    doomed = whole.join(gone.withColumn("matched", F.lit(True)), "sid", "left").where("matched or copies > 1")
    return units.join(doomed, "sid").where(F.col("matched") | (_place("id", "unit") > F.col("place"))).select("id", "unit").distinct()


def _rebuild(at: int):
    """Texts without their gone lines; the last column gives the gone lines and makes way for the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, max(b.num_rows, 1), 500)):
            out, count, less = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = [] if text is None else text.split("\n")
                gone = set(gone or ())
                out.append(text if text is None or not gone else "\n".join([x for i, x in enumerate(lines) if i not in gone]))
                count.append(len(lines)), less.append(len(gone))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols[at] = pa.array(out, pa.string())
            names = [*batch.schema.names[:-1], "_n_lines", "_n_removed"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count, pa.int64()), pa.array(less, pa.int64())], names)

    return tidied(run)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", num: int = 4, den: int = 5, least: int = 1, keep_columns: bool = False) -> DataFrame:
    """(id, text, n_lines, n_removed): each text without the lines that match an earlier one. With ``keep_columns``
    all columns of ``docs`` come back, and the counts as _n_lines and _n_removed (in place of columns of these
    names that ``docs`` has).

    A line is a run between newlines, its tokens the distinct words of it (runs of other than ASCII white space,
    ASCII letters in lower case). Lines match at a Jaccard similarity of num/den or more; the earlier is the one
    of the smaller id, then of the smaller line number. Lines of fewer than ``least`` words (by default the blank
    ones) neither go nor make others go. Ids are whole numbers of up to 64 bits. A null text stays null with no
    lines; an empty one has one line and keeps it. Of rows repeated with one id, none makes the other's lines go,
    but lines that match within the row or an earlier id go in all of them. Rows of null id come back as they
    are. An empty table gives an empty result. Token hashes have 48 bits and set hashes 63: a pair of sets of n
    tokens is misjudged with a chance of about n^2/2^48, and two unequal sets of m are taken as equal with a
    chance of about m^2/2^64 in all."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gone = later_matches(base.where("id is not null"), num, den, max(least, 1))
    own = docs.drop("_n_lines", "_n_removed") if keep_columns else docs.select(id_col, text_col)
    key, numbers = (free_name(x, own.columns) for x in ("gone_id", "gone_lines"))
    gone = gone.groupBy(F.col("id").alias(key)).agg(F.collect_set("unit").alias(numbers))
    # gone lines are a small part of the texts: each partition's are kept in memory, so that no text is sorted
    whole = own.join(gone.hint("shuffle_hash"), own[id_col] == gone[key], "left").drop(key)
    counts = [T.StructField("_n_lines", T.LongType()), T.StructField("_n_removed", T.LongType())]
    out = whole.mapInArrow(_rebuild(own.columns.index(text_col)), T.StructType([*own.schema.fields, *counts]))
    return out if keep_columns else out.withColumnsRenamed({"_n_lines": "n_lines", "_n_removed": "n_removed"})
