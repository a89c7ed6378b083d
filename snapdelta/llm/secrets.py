"""Operator 3: secrets by fixed patterns, and random strings by their token efficiency."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: Strings that may be random: what keys and tokens are made of.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# Known digests and identifiers: hexadecimal digests, UUIDs, numbers, and words joined by - _ / (slugs, paths).
DIGEST = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
RUN = re.compile(r"[A-Za-z0-9]+")
WORD = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+")


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a file; a worker keeps it from task to task."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]


def known(s: str) -> bool:
    """Whether a candidate is a known digest or identifier. Runs are tried one by one: linear in any case."""
    return bool(DIGEST.fullmatch(s)) or all(WORD.fullmatch(x) for x in RUN.findall(s))


def _mixed(s: str) -> bool:
    """Whether letters come with digits, or a run mixes cases otherwise than by a capital first letter."""
    letters = any(c.isalpha() for c in s)
    return letters and (any(c.isdigit() for c in s) or not all(WORD.fullmatch(x) for x in RUN.findall(s)))


def _pieces(s: str) -> Iterator[tuple[int, int]]:
    """What lies between the readable words and the identifiers of a candidate, and each run of 16 in it."""
    breaks = [m.span() for m in UUID.finditer(s)]
    breaks += [m.span() for m in RUN.finditer(s) if DIGEST.fullmatch(m[0]) or len(m[0]) > 2 and WORD.fullmatch(m[0])]
    at = 0
    for a, b in [*sorted(breaks), (len(s), len(s))]:
        runs = [(at + m.start(), at + m.end()) for m in RUN.finditer(s[at:a])] if a - at >= 16 else []
        if runs and runs[-1][1] - runs[0][0] >= 16:
            yield runs[0][0], runs[-1][1]
            if len(runs) > 1:
                yield from (r for r in runs if r[1] - r[0] >= 16)
        at = max(at, b)


def covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans cover together, in order and apart from each other."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    return starts, ends


def random_spans(text: str, taken: list[tuple[int, int, int]], encoding: tiktoken.Encoding, most: float) -> list[tuple[int, int, int]]:
    """Spans of strings that take many tokens for their length: letters with digits or in mixed case, no known
    digest or identifier, not touching a fixed span. A candidate that does not pass whole is tried in pieces."""
    out = []
    starts, ends = covered(taken)

    def passes(a: int, b: int) -> bool:
        last = bisect_left(starts, b) - 1  # the last fixed span that begins before the end
        if last >= 0 and ends[last] > a:
            return False
        s = text[a:b]
        if not _mixed(s) or known(s):
            return False
        return len(s) <= most * len(encoding.encode_ordinary(s))

    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if known(m[0]):
            continue
        if passes(a, b):
            out.append((a, 3, b))
            continue
        end = a
        for x, y in _pieces(m[0]):
            if a + x >= end and passes(a + x, a + y):  # runs of a piece that passed are in it
                out.append((a + x, 3, a + y))
                end = a + y
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _scan(path: str, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            cols = [[], [], [], [], [], []]
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, base, encoding, most)
                for kind in range(3):
                    cols[kind].append(sum(k == kind for _, k, _ in base))
                cols[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                cols[4].append(_joined(base + more))
                cols[5].append(len(more))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return run


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, most: float = 2.0) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for each row.

    Spans are kind:start:end in code points, end exclusive, by start and then in the order of KINDS. The
    fixed patterns match leftmost and without overlap within a kind; too short matches go. ``random`` spans
    have at most ``most`` characters a token under the vocabulary file ``vocabulary`` (a path that each
    worker can read) and hold letters with digits or in mixed case; where a whole string has more, what lies
    between its readable words, and each run between separators, is tried by itself. Digests of known lengths,
    UUIDs, numbers and joined words are left out, and so is what a fixed span covers. A null text counts as empty: no spans. Repeated rows
    come back as often as given; other columns are ignored. An empty table gives an empty result. Long texts, and
    texts of very many spans, take time in proportion to their length."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = base.mapInArrow(_scan(path, most), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
    return out.withColumnRenamed("id", id_col)
