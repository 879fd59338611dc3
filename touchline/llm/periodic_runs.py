"""Periodic runs of words, by online dyadic square catching.

A stream of words is kept in blocks of every power of two.  Once a block of 2**j
words is complete it has a catcher, which compares it with the suffixes of that
length as words are appended, at the distances q with 2**(j+1) - 1 <= 3 * q <
2**(j+2) - 1.  Each q belongs to one level, and at each appended word at most one
catcher of a level looks at each distance, so an append costs O(1) a level.  A
stretch of four periods or more holds, in its first three, a whole block of its
level, so its catcher meets the block again one period later: a catch.  Catches
of neighbouring blocks at the same distance are one stretch; suffix comparisons
carry it to both sides, less than a block each, and it is a run where at least
three periods of words equal the words one period on.  Comparisons use prefix
sums of word numbers; every run is compared word by word before it is told, and
where sums lied the distance is compared in full.

Documents follow one another in a stream with a word of its own between them, so
no square reaches over an end.  Appending word by word or many at once catches
the same squares.

Semantics for odd input: a null or empty text has no words and no runs (four
nulls, digests of nothing); a null doc_id is kept and its words stay as they are;
repeated rows give a row each; a long text is a stream of its own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.text_hash import mix

_U = np.uint64
#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 6, 4
#: Words of short documents that make one stream, and words appended at once.
STREAM, APPEND = 1 << 18, 1 << 17
_BASE = 0x9E3779B97F4A7C55
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def distances(level: int) -> tuple[int, int]:
    """Least and past-largest distance at which blocks of 2**level words are compared."""
    return -(-((2 << level) - 1) // 3), -(-((4 << level) - 1) // 3)


class Catchers:
    """A stream of numbered words with its catchers; ``longest`` bounds the length of a stretch that may be a run."""

    def __init__(self, longest: int):
        self.levels = [j for j in range(1, 60) if PERIODS * distances(j)[0] <= longest]
        self.words = np.zeros(0, np.int64)
        self.sums = np.zeros(1, _U)
        self.up = np.ones(1, _U)
        self.caught: dict[int, list[np.ndarray]] = {j: [] for j in self.levels}

    def append(self, words: np.ndarray) -> int:
        """Add words; the number of squares caught.  Blocks that the words complete get their catchers."""
        was, n = len(self.words), len(self.words) + len(words)
        more = np.full(n + 1 - len(self.up), _BASE, _U)
        more[:1] *= self.up[-1:]
        np.multiply.accumulate(more, out=more)
        self.up = np.concatenate([self.up, more])
        values = mix(words.view(_U) + _U(0x9E3779B97F4A7C15))
        self.sums = np.concatenate([self.sums, self.sums[-1] + np.cumsum(values * self.up[was:n], dtype=_U)])
        self.words = np.concatenate([self.words, words])
        return sum(self._advance(j, was, n) for j in self.levels)

    def _advance(self, level: int, was: int, n: int) -> int:
        """Compare suffixes of 2**level words that end in the words from ``was`` to ``n`` with the blocks before them."""
        size, (least, past) = 1 << level, distances(level)
        lo, hi = max(least, was - size + 1), n - size + 1  # where such suffixes begin
        if lo >= hi:
            return 0
        first, last = max(0, (lo - past) // size), (hi - 1 - least) // size
        blocks = np.arange(first, last + 1) * size
        at = blocks[:, None] + np.arange(least, past)
        live = (at >= lo) & (at < hi)
        k, q = np.nonzero(live & self.alike(blocks[:, None], np.where(live, at, blocks[:, None]), size))
        if len(k):
            self.caught[level].append(np.stack([q + least, k + first], axis=1))
        return len(k)

    def alike(self, a: np.ndarray, b: np.ndarray, size) -> np.ndarray:
        """Whether ``size`` words from ``a`` on have the sums of those from ``b`` on (a <= b)."""
        return (self.sums[a + size] - self.sums[a]) * self.up[b - a] == self.sums[b + size] - self.sums[b]

    def runs(self) -> np.ndarray:
        """Rows (start, length, period) of all runs so far, by start, then period."""
        found = [self._merge(j, np.concatenate(caught)) for j, caught in self.caught.items() if caught]
        found = np.concatenate([np.zeros((0, 3), np.int64), *found])
        first = _smallest(found)
        if not all(self._exact(*x) for x in first.tolist()):  # some sum lied: compare every stretch by words
            exact = [[x] if self._exact(*x) else self._plain(x[2]) for x in found.tolist()]
            first = _smallest(np.array(sum(exact, []), np.int64).reshape(-1, 3))
        return first

    def _exact(self, start: int, length: int, p: int) -> bool:
        w, a, b = self.words, start, start + length - p
        return bool((w[a:b] == w[a + p : b + p]).all() and (a == 0 or w[a - 1] != w[a - 1 + p]) and (b + p == len(w) or w[b] != w[b + p]))

    def _merge(self, level: int, caught: np.ndarray) -> np.ndarray:
        size, n = 1 << level, len(self.words)
        caught = caught[np.lexsort((caught[:, 1], caught[:, 0]))]
        q, k = caught[:, 0], caught[:, 1]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (k[1:] != k[:-1] + 1)
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(q)) - 1
        q, lo, hi = q[at], k[at] * size, (k[end] + 1) * size
        left, right = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for step in (1 << j for j in range(level, -1, -1)):
            for side, room in ((left, lo - left - step >= 0), (right, hi + right + q + step <= n)):
                own = np.flatnonzero(room)
                a = (lo - left - step if side is left else hi + right)[own]
                side[own[self.alike(a, a + q[own], step)]] += step
        lo, hi = lo - left, hi + right
        enough = (hi - lo >= (PERIODS - 1) * q) & (hi - lo + q >= LEAST)
        return np.stack([lo, hi - lo + q, q], axis=1)[enough]

    def _plain(self, p: int) -> list[tuple[int, int, int]]:
        """The stretches of a period by comparing every word."""
        same = np.concatenate([[False], self.words[:-p] == self.words[p:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        return [(a, b - a + p, p) for a, b in edge.reshape(-1, 2).tolist() if b - a >= (PERIODS - 1) * p and b - a + p >= LEAST]


def _smallest(found: np.ndarray) -> np.ndarray:
    """Distinct stretches with the smallest of their periods: a stretch is found with multiples of it, too."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def find_runs(documents: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs (start, length, period)."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(documents):
        end, total = at, 0
        while end < len(documents) and (end == at or total + len(documents[end]) <= STREAM):
            total += len(documents[end])
            end += 1
        out += _stream(documents[at:end])
        at = end
    return out


def _stream(documents: list[list[bytes]]) -> list[np.ndarray]:
    lengths = np.array([len(d) for d in documents], np.int64)
    catchers = Catchers(int(lengths.max()))
    starts = np.cumsum(lengths + 1) - lengths - 1
    if not catchers.levels:
        return [np.zeros((0, 3), np.int64)] * len(documents)
    number: dict[bytes, int] = {}
    line = np.empty(int(lengths.sum()) + len(documents), np.int64)
    for d, lo in zip(documents, starts.tolist(), strict=True):
        line[lo : lo + len(d)] = [number.setdefault(w, len(number)) for w in d]
    line[starts + lengths] = -1 - np.arange(len(documents))  # a word of its own after each document
    for lo in range(0, len(line), APPEND):
        catchers.append(line[lo : lo + APPEND])
    runs = catchers.runs()
    cuts = np.searchsorted(runs[:, 0], np.append(starts, len(line)))
    return [runs[a:b] - [lo, 0, 0] for a, b, lo in zip(cuts[:-1].tolist(), cuts[1:].tolist(), starts.tolist(), strict=True)]


def loop_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of which one document in ten has a looped tail (by its id)."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those of a run after its first period, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def report_runs(documents: DataFrame, looped: bool = True) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every document.

    ``looped``: put a loop at the end of one document in ten, as ``loop_tail`` does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(1).fill_null("")))
            for lo, hi in _cuts(sizes, 1 << 22):
                part = batch.slice(lo, hi - lo)
                ids = part.column(0).to_pylist()
                texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in part.column(1)]
                if looped:
                    texts = [loop_tail(w, i) for w, i in zip(texts, ids, strict=True)]
                yield _rows(part.column(0), texts, find_runs(texts))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def _cuts(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, or one row."""
    out, lo, total = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and total + size > limit:
            out.append((lo, i))
            lo, total = i, 0
        total += size
    return [*out, (lo, len(sizes))] if lo < len(sizes) else out


def _rows(ids: pa.Array, texts: list[list[bytes]], runs: list[np.ndarray]) -> pa.RecordBatch:
    best: list[tuple] = []
    for r in runs:
        if len(r):
            start, length, period = r[np.lexsort((r[:, 2], r[:, 0], -r[:, 1]))[0]].tolist()
            best.append((start, length, period, 1000 * length // period))
        else:
            best.append((None,) * 4)
    told = [hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in r.tolist()).encode()).hexdigest() for r in runs]
    kept = [hashlib.sha256(collapse(w, r)).hexdigest() for w, r in zip(texts, runs, strict=True)]
    columns = [ids, pa.array([len(r) for r in runs], pa.int64()), *(pa.array([b[i] for b in best], pa.int64()) for i in range(4)), pa.array(told, pa.string()), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCHEMA.split(", ")])
