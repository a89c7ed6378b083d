"""Operator 7: byte-level BPE by backtracking over longest matches.

Bytes are read as Latin-1 characters, so that an Aho-Corasick automaton over text finds all tokens. From
left to right the longest match is taken if it can stand after the token before it; two tokens are
compatible if BPE of their joined bytes gives just these two (memoised). Where no match fits, the last token
is taken back and a shorter one tried; an end that failed is never tried again, so the work is linear. An
encoding whose neighbours are all compatible is the one that the merges give."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of one generation of the memo, the longest piece it keeps, and pairs of tokens in the memo of pairs.
_MEMO, _MEMO_LENGTH, _PAIRS = 1 << 16, 48, 1 << 17


#: Texts whose ids are held at once.
_TEXTS = 500


class _Pieces(dict):
    """Pieces to (ids joined by a space, how many, bytes decoded from them). Two generations of bounded size: what is
    met again moves on to the new one, what is not goes with the old."""

    def __init__(self, of: BytePairs):
        super().__init__()
        self.of, self.old = of, {}

    def __missing__(self, piece: str) -> tuple[str, int, bytes]:
        got = self.old.get(piece)
        if got is None:
            ids, of = self.of.encode_bytes(piece.encode("utf-8", "surrogatepass")), self.of
            got = (" ".join([of.name[t] for t in ids]), len(ids), of.decode(ids))
        if len(piece) <= _MEMO_LENGTH:
            if len(self) >= _MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class BytePairs:
    """The vocabulary of a rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token: list[bytes] = [b""] * (max(self.rank.values(), default=-1) + 1)
        for b, i in self.rank.items():
            self.token[i] = b
        self.name = [str(i) for i in range(len(self.token))]
        self.split = regex.compile(pattern)
        self.found = ahocorasick.Automaton()
        for b, i in self.rank.items():
            self.found.add_word(b.decode("latin-1"), (i, len(b) - 1))
        self.found.make_automaton()
        self.length = [len(b) for b in self.token]
        # the longest token that is a proper beginning of each, or -1
        self.shorter = [next((self.rank[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.rank), -1) for b in self.token]
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.memo = _Pieces(self)

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """BPE by its definition, for short input: join the neighbours of the lowest rank, leftmost first, until
        nothing can be joined or ``until`` parts are left."""
        rank = self.rank
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            low, at = min((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if low == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def made_of(self, t: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; None for a byte, and for a token that the merges
        never make of its own bytes."""
        got = self.halves.get(t, 0)
        if got == 0:
            b = self.token[t]
            two = self.merged(b, 2) if len(b) > 1 else []
            got = self.halves[t] = (two[0], two[1]) if len(two) == 2 and self.rank.get(self.token[two[0]] + self.token[two[1]]) == t else None
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of the joined bytes end in just these two tokens: no merge across their border comes
        before those that make them. Undoes the merges from the last one on, always the later of both sides."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._stand_together(a, b)
        return got

    def _stand_together(self, a: int, b: int) -> bool:
        rank, token = self.rank, self.token
        left, right, undone = a, b, 1 << 60  # a merge across the border of this rank or later comes too late
        while True:
            across = rank.get(token[left] + token[right])
            if across is not None and across < undone:
                return False
            # the border as it was before the latest merge on either side; on the same rank the left one comes first
            of_left, of_right = self.made_of(left), self.made_of(right)
            if of_left is None and of_right is None:
                return True
            if of_right is None or (of_left is not None and left > right):
                undone, left = left, of_left[1]
            else:
                undone, right = right + 1, of_right[0]

    def merged_whole(self, t: int) -> bool:
        """Whether the merges make this token of its own bytes."""
        return self.length[t] == 1 or self.made_of(t) is not None

    def encode_bytes(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)
        if whole is not None and self.merged_whole(whole):
            return [whole]
        n, length, shorter, pairs = len(data), self.length, self.shorter, self.pairs
        longest = [-1] * n
        for end, (t, before) in self.found.iter(data.decode("latin-1")):
            longest[end - before] = t  # ends come in order, so the last is the longest
        dead: set[int] = set()
        out: list[int] = []
        pos, last, t = 0, -1, longest[0] if n else -1
        while pos < n:
            while t >= 0:
                end = pos + length[t]
                if end not in dead:
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | t)
                    if fits is None:
                        fits = self.compatible(last, t)
                    if fits:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                if end == n:
                    break
                pos, last, t = end, t, longest[end]
            else:
                dead.add(pos)
                t = out.pop()
                pos -= length[t]
                last = out[-1] if out else -1
        return out

    def pieces(self, text: str) -> list[tuple[str, int, bytes]]:
        """(ids joined by a space, how many, bytes decoded from them) of each match of the pattern."""
        return list(map(self.memo.__getitem__, self.split.findall(text)))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


_LOADED: dict[tuple[str, str], BytePairs] = {}


def loaded(path: str, pattern: str) -> BytePairs:
    """The vocabulary and its memos, once for each worker process: a task finds what earlier ones have learned."""
    if (path, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, pattern] = BytePairs(path, pattern)
    return _LOADED[path, pattern]


def _worker(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in (b.slice(lo, _TEXTS) for b in batches for lo in range(0, b.num_rows, _TEXTS)):
            n, ids, ids_hash, text_hash = [], [], [], []
            for text in batch.column("text"):
                got = bpe.pieces(text.as_py() or "")
                joined = " ".join([x[0] for x in got])
                n.append(sum([x[1] for x in got]))
                ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                text_hash.append(hashlib.sha256(b"".join([x[2] for x in got])).hexdigest())
                if keep_ids:
                    ids.append(pa.array(joined.split(), pa.string()).cast(pa.int32()))
            cols = [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                offsets = pa.array([0, *n], pa.int32()).to_numpy().cumsum().astype("int32")
                values = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
                cols, names = [*cols, pa.ListArray.from_arrays(pa.array(offsets), values)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_decode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row: encode the whole text, decode the ids.

    ``ranks`` is a rank file that each worker can read. Each match of ``pattern`` is encoded by itself; there are
    no special tokens. A null text counts as empty: no tokens, the hashes of nothing. Repeated rows come back
    as often as given; an empty table gives an empty result; other columns are ignored."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return base.mapInArrow(_worker(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern, keep_ids), schema).withColumnRenamed("id", id_col)
