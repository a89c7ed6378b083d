"""Line diffs in pieces between anchors, and word segments of changed lines."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most bytes of the table that a comparison keeps; a larger one keeps every n-th row and works the others out again.
TABLE_BYTES = 64_000_000
#: Pieces of a line (fixed values): a line break, a word, white space, any other character.
WORD = "a-zA-Z0-9_­À-ÖØ-öø-ˆˈ-˗˞-˿Ḁ-ỿ"
PIECE = re.compile(rf"\r?\n|[{WORD}]+|[^\S\n\r]+|[^{WORD}]")
#: A pair of lines that share less of the longer one says nothing.
LEAST_SHARED = 0.25


def longest_common(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, so that what is left is a shortest edit script.

    One row of the usual table is a bit vector over ``b``, and the next follows by a sum and a few logical operations
    on whole words, however often items repeat. Rows are kept for the way back, every n-th of a large table."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < len(a) - lo and end < len(b) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[lo : len(a) - end], b[lo : len(b) - end]
    places: dict = {}
    for j, v in enumerate(y):
        places.setdefault(v, []).append(j)
    width = len(y) // 8 + 1
    full = (1 << (8 * width)) - 1
    masks = {}
    for v in set(x):
        bits = np.zeros(8 * width, np.uint8)
        bits[places.get(v, [])] = 1
        masks[v] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    every = max(1, len(x) * width // TABLE_BYTES)

    def rows(first: int, last: int, state: int) -> Iterator[int]:
        for i in range(first, last):
            hit = state & masks[x[i]]
            state = ((state + hit) | (state - hit)) & full
            yield state

    kept, state = [full], full  # the state before rows 0, every, 2 every, ...
    for i, state in enumerate(rows(0, len(x), full), 1):
        if i % every == 0:
            kept.append(state)
    middle, held, at = [], [], -1
    i, j = len(x), len(y)

    def grows(row: int, col: int) -> bool:
        """Whether the table grows from col - 1 to col in the row (0: before the first)."""
        nonlocal held, at
        if row == 0:
            return False
        block = (row - 1) // every
        if block != at:
            held = [s.to_bytes(width, "little") for s in rows(block * every, min((block + 1) * every, len(x)), kept[block])]
            at = block
        return not (held[row - 1 - block * every][(col - 1) >> 3] >> ((col - 1) & 7)) & 1

    while i and j:
        if not grows(i, j):
            j -= 1
        elif grows(i - 1, j):
            i -= 1
        else:
            i, j = i - 1, j - 1
            middle.append((lo + i, lo + j))
    return [(n, n) for n in range(lo)] + middle[::-1] + [(len(a) - n, len(b) - n) for n in range(end, 0, -1)]


def rising(places: np.ndarray) -> np.ndarray:
    """Which of some distinct numbers form a longest rising run, not necessarily side by side."""
    tails, at = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
    before, n = np.full(len(places), -1, np.int64), 0
    for i, v in enumerate(places):
        k = int(np.searchsorted(tails[:n], v))
        before[i] = at[k - 1] if k else -1
        tails[k], at[k], n = v, i, max(n, k + 1)
    keep, i = np.zeros(len(places), bool), at[n - 1] if n else -1
    while i >= 0:
        keep[i] = True
        i = before[i]
    return keep


def anchors(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """(key, base_line, head_line): lines that occur once on each side of a file, as many as keep their order. Only line
    numbers of such lines meet in one task for each file."""
    once = lambda df, name: df.groupBy(key, F.xxhash64("content").alias("h1"), F.md5("content").alias("h2")).agg(F.count("*").alias("n"), F.min("line").alias(name)).where("n = 1").drop("n")
    both = once(base, "base_line").join(once(head, "head_line"), [key, "h1", "h2"]).select(key, "base_line", "head_line")

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (k,), rows in groups(batches, 1):
            at = np.array(rows, np.int64)
            keep = at[rising(at[:, 1])]
            yield pd.DataFrame({key: [k] * len(keep), "base_line": keep[:, 0], "head_line": keep[:, 1]})

    return both.repartition(key).sortWithinPartitions(key, "base_line").mapInPandas(kept, both.schema)


_DIFF = "op string, base_line long, head_line long, text string"


def groups(batches: Iterator[pd.DataFrame], n: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of a sorted partition by their first ``n`` columns; a group is held as a whole, and no more."""
    last, held = None, []
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            if row[:n] != last:
                if held:
                    yield last, held
                last, held = row[:n], []
            held.append(row[n:])
    if held:
        yield last, held


def _pieces(key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for (k, _), rows in groups(batches, 2):
            a, b = ([r[1:] for r in rows if r[0] == side] for side in (0, 1))
            i = j = 0
            for x, y in [*longest_common([r[1] for r in a], [r[1] for r in b]), (len(a), len(b))]:
                out += [(k, "remove", n, None, t) for n, t in a[i:x]] + [(k, "add", None, n, t) for n, t in b[j:y]]
                if x < len(a) and y < len(b):
                    out.append((k, "keep", a[x][0], b[y][0], a[x][1]))
                i, j = x + 1, y + 1
            if len(out) > 10_000:
                yield framed(out)
                out = []
        yield framed(out)

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[key, "op", "base_line", "head_line", "text"]).astype({"base_line": "Int64", "head_line": "Int64"})

    return run


def line_diff(base: DataFrame, head: DataFrame, key: str, anchored: bool = True) -> DataFrame:
    """Line by line: kept, removed and added lines of each pair of files (key, line, content), with their numbers on both
    sides.

    Lines that occur once on each side anchor the comparison where they keep their order (a longest rising run of
    them); a shortest edit script is then found for each piece between two anchors by itself, so that one large file
    spans tasks. A piece of one side only needs no comparison. The script as a whole is shortest wherever no equal lines
    lie across an anchor; without ``anchored`` it always is, at one task a file. Rows of a null key belong to no file
    and go."""
    base, head = (df.select(key, F.col("line").cast("long").alias("line"), "content").where(F.col(key).isNotNull()) for df in (base, head))
    fixed = anchors(base, head, key)
    fixed = fixed if anchored else fixed.limit(0)
    mark = lambda s, c: fixed.select(key, F.lit(s).alias("side"), F.col(c).alias("line"), F.lit(1).alias("anchor"), "base_line", "head_line")
    marks = mark(0, "base_line").unionByName(mark(1, "head_line"))
    lines = base.select(key, F.lit(0).alias("side"), "line", "content").union(head.select(key, F.lit(1), "line", "content"))
    lines = lines.join(marks, [key, "side", "line"], "left")
    piece = F.sum(F.coalesce("anchor", F.lit(0))).over(W.partitionBy(key, "side").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    lines = lines.withColumn("piece", piece)
    kept = lines.where("anchor = 1 and side = 0").select(key, F.lit("keep").alias("op"), "base_line", "head_line", F.col("content").alias("text"))
    loose = lines.where("anchor is null").select(key, "piece", "side", "line", "content")
    w = W.partitionBy(key, "piece")
    loose = loose.withColumn("mixed", F.min("side").over(w) != F.max("side").over(w))
    on = lambda s: F.when(F.col("side") == s, F.col("line"))
    alone = loose.where("not mixed").select(key, F.when(F.col("side") == 0, "remove").otherwise("add").alias("op"), on(0).alias("base_line"), on(1).alias("head_line"), F.col("content").alias("text"))
    kind = base.schema[key].dataType.simpleString()
    mixed = loose.where("mixed").select(key, "piece", "side", "line", "content").repartition(key, "piece").sortWithinPartitions(key, "piece", "side", "line")
    compared = mixed.mapInPandas(_pieces(key), f"{key} {kind}, {_DIFF}")
    return kept.union(alone).union(compared)


def segments(removed: str, added: str) -> tuple[float, list[tuple[str, str]], list[tuple[str, str]]]:
    """The share of the longer of two lines that both have, in characters, and each line as runs of equal and changed
    text, white space kept."""
    a, b = PIECE.findall(removed), PIECE.findall(added)
    sides: tuple[list, list] = ([], [])

    def put(side: int, kind: str, text: str) -> None:
        if text and sides[side] and sides[side][-1][0] == kind:
            sides[side][-1] = (kind, sides[side][-1][1] + text)
        elif text:
            sides[side].append((kind, text))

    i = j = equal = 0
    for x, y in [*longest_common(a, b), (len(a), len(b))]:
        put(0, "changed", "".join(a[i:x])), put(1, "changed", "".join(b[j:y]))
        if x < len(a) and y < len(b):
            put(0, "equal", a[x]), put(1, "equal", b[y])
            equal += len(a[x])
        i, j = x + 1, y + 1
    return equal / max(1, len(removed), len(added)), *sides


_RUN = "array<struct<kind: string, text: string>>"


def word_pairs(diff: DataFrame, key: str) -> DataFrame:
    """Removed and added lines of a diff (key, op, base_line, head_line, text) paired within each block of change, the k-th
    removed with the k-th added: (key, block, k, removed, added, ratio, removed_segments, added_segments). Pairs that
    share less than a quarter of the longer line are left out."""
    kept = diff.where("op = 'keep'").select(key, "base_line", "head_line")
    block = diff.where("op <> 'keep'")
    # a change belongs to the last kept line before it, on its own side
    marks = kept.select(key, F.lit("remove").alias("op"), F.col("base_line").alias("pos"), F.lit(0).alias("is_change"), F.col("base_line").alias("anchor"), F.lit(None).cast("string").alias("text"))
    marks = marks.union(kept.select(key, F.lit("add"), F.col("head_line"), F.lit(0), F.col("base_line"), F.lit(None).cast("string")))
    rows = block.select(key, "op", F.when(F.col("op") == "remove", F.col("base_line")).otherwise(F.col("head_line")).alias("pos"), F.lit(1).alias("is_change"), F.lit(None).cast("long").alias("anchor"), "text").union(marks.select(key, "op", "pos", "is_change", "anchor", "text"))
    side = W.partitionBy(key, "op").orderBy("pos", "is_change").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("block", F.coalesce(F.last("anchor", True).over(side), F.lit(0).cast("long"))).where("is_change = 1")
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy(key, "op", "block").orderBy("pos")))
    r = rows.where("op = 'remove'").select(key, "block", "k", F.col("text").alias("removed"))
    a = rows.where("op = 'add'").select(key, "block", "k", F.col("text").alias("added"))
    both = r.join(a, [key, "block", "k"])

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [segments(x, y) for x, y in zip(rows["removed"], rows["added"])]
            runs = lambda at: [[{"kind": k, "text": t} for k, t in g[at]] for g in got]
            rows = rows.assign(ratio=[round(g[0], 6) for g in got], removed_segments=runs(1), added_segments=runs(2))
            yield rows[[g[0] >= LEAST_SHARED for g in got]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema)
    return both.mapInPandas(compared, f"{schema}, ratio double, removed_segments {_RUN}, added_segments {_RUN}")
