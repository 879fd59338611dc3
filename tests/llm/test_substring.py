"""Substring dedup against a search of all windows, over many blocks and shards; the automaton by itself; odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from touchline.llm import substring, text_hash
from touchline.llm.substring import WINDOW, Automaton, remove_repeats


def plain(rows):
    """(doc_id, n_words, n_removed, kept_sha256) by a table of every window's earliest start."""
    texts = [(i, (1 << 63) - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for _, key, w in texts:
        for s in range(len(w) - WINDOW + 1):
            g = tuple(w[s : s + WINDOW])
            least[g] = min(least.get(g, (key, s)), (key, s))
    out = []
    for i, key, w in texts:
        gone = {p for s in range(len(w) - WINDOW + 1) if least[tuple(w[s : s + WINDOW])] < (key, s) for p in range(s, s + WINDOW)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "ñandú", "日本", "A.B,", "a.b,"]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    line, passage = prose(10), prose(45)
    docs = [prose(r.choice([0, 3, 19, 20, 21, 60, 200])) for _ in range(n)]
    for d in docs[: n // 3]:
        at = r.randrange(len(d) + 1)
        d[at:at] = line
    for d in docs[n // 4 : n // 2]:
        at = r.randrange(len(d) + 1)
        d[at:at] = passage
    for _ in range(n // 3):  # copies with edits
        d = list(r.choice(docs))
        for _ in range(r.randrange(4)):
            if d:
                d[r.randrange(len(d))] = r.choice(vocabulary)
        docs.append(d)
    docs.append(["q"] * 300)
    docs.append(prose(7) * 40)
    docs.append([w.upper() for w in passage])
    r.shuffle(docs)
    return [(i * 3 % 1009, r.choice([" ", "\n", " \t"]).join(d)) for i, d in enumerate(docs)]


def result(spark, rows, **k):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, place string").repartition(3)
    return sorted((tuple(r) for r in remove_repeats(df, **k).collect()), key=repr)


@pytest.mark.parametrize(("block", "windows"), [(1500, 40), (20_000, 1 << 19), (8 << 20, 1 << 19)])
def test_equals_a_search_of_all_windows(spark, monkeypatch, block, windows):
    rows = corpus(block)
    got, want = result(spark, rows, block=block, windows=windows), plain(rows)
    assert got == want
    assert sum(x[2] for x in want) > 1000


def test_odd_rows(spark):
    long = " ".join("v%d" % (i % 5000) for i in range(12_000))
    rows = [(1, "a b " * 15), (1, "a b " * 15), (None, "a b " * 15), (2, None), (3, ""), (4, " \n"), (5, "a b " * 15 + "end"), (6, long), (7, long[5000:40_000]), (5, "x " * 25), (8, "x " * 19), (-9, "c d " * 15)]
    rows += [(20, " ".join("p%d" % i for i in range(a, a + 60))) for a in (0, 20, 35)]  # rows that repeat an id and overlap
    rows += [(21, " ".join("p%d" % i for i in range(10, 80)))]
    for block in (400, 1 << 20):
        assert result(spark, rows, block=block) == plain(rows)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).collect() == []


def test_a_line_in_ever_new_surroundings_is_dealt_by_surroundings(spark):
    r = random.Random(3)
    data = lambda w: np.frombuffer(" ".join(w).encode(), np.uint8)
    least = lambda w: text_hash.grams(text_hash.words(data(w), np.array([0, len(data(w))]), lower=False)[0], 8).min()
    line = min((["l%d" % (k * 9 + i) for i in range(9)] for k in range(300)), key=least)  # its shingle is an anchor nearly everywhere
    rows = [(i, " ".join(["u%d" % r.randrange(10**6) for _ in range(8)] + line + ["u%d" % r.randrange(10**6) for _ in range(8)])) for i in range(400)]
    rows += [(1000 + i, t) for i, t in rows[:40]]
    index = substring.write_blocks(spark.createDataFrame(rows, "doc_id long, text string"), 4000)
    hot = substring.hot_anchors(index)
    assert 0 < len(hot) <= 4
    assert result(spark, rows, block=4000, windows=100) == plain(rows)


def test_automaton_finds_what_comes_first():
    r = random.Random(8)
    for _ in range(40):
        refs = sorted({(r.randrange(6), 0) for _ in range(4)})
        texts = [[b"%d" % r.randrange(2) for _ in range(r.randrange(1, 60))] for _ in refs]
        automaton = Automaton()
        for (doc, pos), t in zip(refs, texts, strict=True):
            automaton.add(t, doc, pos)
        assert len(automaton.length) <= 2 * sum(map(len, texts)) + 1
        query, doc, pos = [b"%d" % r.randrange(2) for _ in range(80)], r.randrange(7), r.randrange(5)
        for window in (3, 5, 9):
            gone = set()
            for s in range(len(query) - window + 1):
                g = query[s : s + window]
                if any(t[k : k + window] == g and (d, k) < (doc, pos + s) for (d, _), t in zip(refs, texts, strict=True) for k in range(len(t) - window + 1)):
                    gone |= set(range(s, s + window))
            spans = automaton.earlier(query, doc, pos, window)
            assert [p for a, b in spans for p in range(a, b)] == sorted(gone)


def test_places_hold_blocks_words_and_windows():
    place = substring._place((1 << 31) + 5, np.array([123_456_789]), 13)
    assert place[0] > 0
    assert int(place[0] >> 31) == (1 << 31) + 5
    assert int(place[0] >> 4 & ((1 << 27) - 1)) == 123_456_789
