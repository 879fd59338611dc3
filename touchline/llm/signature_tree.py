"""Signature trees over token sets, and their join by dual traversal.

A node holds the OR of its sets' token bitmaps, the range of their sizes and
their largest excess of tokens over bits.  Two nodes can hold a linked pair only
if the common bits plus the smaller excess reach the least overlap that sizes in
their ranges need.  Leaves are compared exactly.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
_CHUNK = 16384


class Similar:
    """Links at ``percent`` / 100 of Jaccard similarity, in whole numbers."""

    def __init__(self, percent: int = 75):
        self.percent = percent

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least overlap of linked sets of at least a and b tokens."""
        p = self.percent
        return np.maximum(-(-p * (a + b) // (100 + p)), -(-p * np.maximum(a, b) // 100))

    def sizes_fit(self, low_a, high_a, low_b, high_b):
        return (100 * high_a >= self.percent * low_b) & (100 * high_b >= self.percent * low_a)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if not len(a) or 100 * len(a) < self.percent * len(b):
            return False
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        common = int(np.count_nonzero(b[at] == a))
        return 100 * common >= self.percent * (len(a) + len(b) - common)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of ``bits`` / 64 words for each set; a token's bit is its value modulo ``bits``."""
    words = np.zeros((len(sets), bits // 64), dtype=np.uint64)
    step = max(1, (8 << 20) // bits)
    for at in range(0, len(sets), step):
        own = sets[at : at + step]
        flags = np.zeros((len(own), bits), dtype=np.uint8)
        for row, s in enumerate(own):
            flags[row, (s & np.uint64(bits - 1)).astype(np.int64)] = 1
        words[at : at + len(own)] = np.packbits(flags, axis=1).view(np.uint64)
    return words


class SignatureTree:
    """Levels of nodes from the leaves (single sets, in the given order) up to one root."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        excess = sizes - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        self.levels = [(words, sizes, sizes, excess)]
        while len(self.levels[-1][1]) > 1:
            words, low, high, excess = self.levels[-1]
            cuts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(words, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(excess, cuts)))

    def traverse(self, similar: Similar, ahead=None):
        """Arrays (i, j) of leaf pairs that no level rules out, in pieces.

        ``ahead(level, i, j)`` may rule out further node pairs.
        """
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > _CHUNK:
                half = len(i) // 2
                stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
                continue
            if ahead is not None:
                ok = ahead(level, i, j)
                i, j = i[ok], j[ok]
            ok = self.survivors(level, i, j, similar)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if not level:
                yield i, j
                continue
            width = len(self.levels[level - 1][1])
            a = i[:, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)
            b = j[:, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)
            good = (a < width) & (b < width) & ((i != j)[:, None] | (a < b if level == 1 else a <= b))
            stack.append((level - 1, a[good], b[good]))

    def survivors(self, level: int, i: np.ndarray, j: np.ndarray, similar: Similar) -> np.ndarray:
        """Which node pairs can hold a linked pair."""
        words, low, high, excess = self.levels[level]
        ok = similar.sizes_fit(low[i], high[i], low[j], high[j])
        at = np.flatnonzero(ok & (i != j))
        overlap = np.bitwise_count(words[i[at]] & words[j[at]]).sum(axis=1, dtype=np.int64) + np.minimum(excess[i[at]], excess[j[at]])
        ok[at] = overlap >= similar.needed(low[i[at]], low[j[at]])
        return ok


def partners(words: np.ndarray, sizes: np.ndarray, similar: Similar, asking: np.ndarray) -> np.ndarray:
    """Which sets can link with another, as far as bitmaps and sizes tell; of two, one at least is ``asking``."""
    out = np.zeros(len(sizes), dtype=bool)
    order = np.argsort(sizes, kind="stable")
    for i, j in SignatureTree(words[order], sizes[order]).traverse(similar):
        i, j = order[i], order[j]
        ok = asking[i] | asking[j]
        out[i[ok]] = out[j[ok]] = True
    return out


def join(sets: list[np.ndarray], similar: Similar, forest: Forest, wanted: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect the positions of ``sets`` as all their links do.

    ``forest`` has the connections known so far: node pairs whose sets are all
    connected are passed over.  With ``wanted``, only pairs with a position
    where it holds are compared.
    """
    found: list[tuple[int, int]] = []
    n = len(sets)
    if n <= FANOUT:
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
        _compare(pairs, sets, similar, forest, wanted, found)
        return found
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    least = np.array([int(s[0]) if len(s) else 0 for s in sets], dtype=np.uint64)
    order = np.lexsort((least, sizes))  # near sizes together, and likely copies among them
    bits = 1 << int(np.clip(np.ceil(np.log2(max(2, 4 * int(sizes.max())))), 8, 14))
    tree = SignatureTree(bitmaps([sets[i] for i in order], bits), sizes[order])
    component = np.array([forest.root(i) for i in range(n)])[order]
    wants = np.ones(n, bool) if wanted is None else wanted[order]
    known = [(component, component, wants)]
    for _ in tree.levels[1:]:
        lowest, highest, some = known[-1]
        cuts = np.arange(0, len(lowest), FANOUT)
        known.append((np.minimum.reduceat(lowest, cuts), np.maximum.reduceat(highest, cuts), np.logical_or.reduceat(some, cuts)))

    def ahead(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        lowest, highest, some = known[level]
        return ((lowest[i] != highest[j]) | (highest[i] != lowest[j])) & (some[i] | some[j])

    for i, j in tree.traverse(similar, ahead):
        _compare(zip(order[i].tolist(), order[j].tolist(), strict=True), sets, similar, forest, wanted, found)
    return found


def _compare(pairs, sets, similar, forest, wanted, found) -> None:
    for i, j in pairs:
        if i != j and (wanted is None or wanted[i] or wanted[j]) and forest.root(i) != forest.root(j) and similar.linked(sets[i], sets[j]):
            forest.union(i, j)
            found.append((i, j))
