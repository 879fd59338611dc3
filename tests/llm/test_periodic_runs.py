"""Periodic runs against a plain search, whatever is appended at once; looped tails; odd rows."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from touchline.llm import periodic_runs
from touchline.llm.periodic_runs import Catchers, distances, find_runs, loop_tail, report_runs


def plain_runs(w):
    """Every stretch of equal distances, told with its smallest period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j + 1 if j > i else i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def some_words(rng):
    d = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(120))]
    if d and rng.random() < 0.6:
        a, p = rng.randrange(len(d)), rng.randrange(1, 30)
        d = d[:a] + (d[a : a + p] * 50)[: rng.randrange(1, 150)] + d[a:]
    return d


def test_distances_belong_to_one_level_each():
    told = [q for j in range(1, 12) for q in range(*distances(j))]
    assert told == list(range(1, len(told) + 1))


def test_runs_equal_a_plain_search():
    rng = random.Random(4)
    docs = [some_words(rng) for _ in range(800)]
    assert [[tuple(x) for x in r.tolist()] for r in find_runs(docs)] == [plain_runs(d) for d in docs]


@pytest.mark.parametrize("step", [1, 2, 7, 64])
def test_appends_of_any_size_catch_the_same(step):
    rng = random.Random(step)
    for d in (some_words(rng) for _ in range(60)):
        if len(d) < 6:
            continue
        number = {}
        line = np.array([number.setdefault(w, len(number)) for w in d])
        catchers = Catchers(len(d))
        caught = sum(catchers.append(line[i : i + step]) for i in range(0, len(line), step))
        runs = [tuple(x) for x in catchers.runs().tolist()]
        assert runs == plain_runs(d)
        assert caught or not runs


def test_sums_that_lie_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x % np.uint64(2))
    rng = random.Random(9)
    docs = [[b"%d" % rng.randrange(6) for _ in range(40)] + [b"a", b"b"] * 9 for _ in range(50)]
    for d, r in zip(docs, find_runs(docs), strict=True):
        assert {tuple(x) for x in r.tolist()} <= set(plain_runs(d))


def test_work_follows_the_words_on_one_word_repeated():
    def took(n):
        began = time.perf_counter()
        (runs,) = find_runs([[b"a"] * n])
        assert runs.tolist() == [[0, n, 1]]
        return time.perf_counter() - began

    took(1000)
    assert took(160_000) < 16 * max(took(20_000), 0.02)


def test_reports_of_odd_rows(spark):
    rows = [(1, "a b " * 10, 5), (None, "x " * 7, 5), (2, None, 5), (3, "", 5), (4, "one two", 5), (1, "a b " * 10, 5), (5, "p q r\n" * 30 + " tail " + "z\t" * 9, 5), (40, "q " * 4, 5)]
    rows += [(i, " ".join("w%d" % (k * k % 97) for k in range(i)), 5) for i in range(100, 180)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = sorted((tuple(r) for r in report_runs(df).collect()), key=repr)
    want = []
    for i, text, _ in rows:
        w = (text or "").encode().split()
        h = zlib.crc32(str(i).encode())
        if i is not None and w and h % 10 == 0:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        best = min(((-n, a, q) for a, n, q in runs), default=None)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        told = "".join("%d,%d,%d\n" % r for r in runs)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        four = (None,) * 4 if best is None else (best[1], -best[0], best[2], -best[0] * 1000 // best[2])
        want.append((i, len(runs), *four, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t, _ in rows if t and i)
    assert report_runs(df.limit(0)).collect() == []


def test_loop_tail_keeps_length():
    for i in range(200):
        w = [b"%d" % k for k in range(i)]
        assert len(loop_tail(w, i)) == i
