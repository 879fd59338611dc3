"""Whitening against exact integer sums and numpy; odd vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from touchline.llm.whitening import cross_products, planes, scatter, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def make(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], schema).repartition(3)


def plain(rows, d):
    """{(vec_id, component): ...} by Python integers and numpy, of vectors of length d."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    deviations = sorted((i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in good)
    centred = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:4]
    return n, sums, deviations, e[order], v[:, order], e.sum(), good


def test_planes_give_exact_products():
    r = np.random.default_rng(1)
    for n, d, size in ((1, 3, 10), (63, 2, 2), (100, 5, 300), (5000, 7, 200), (9000, 4, 1 << 40), (50, 3, 1 << 62)):
        x = r.integers(-size, size, (n, d))
        assert (scatter(x) == x.astype(object).T @ x.astype(object)).all()
    u = r.integers(0, 50, (70, 3)).astype(np.uint64)
    assert (cross_products(planes(u)) == u.astype(object).T @ u.astype(object)).all()


def test_equals_numpy(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(900, 9)) @ r.normal(size=(9, 9)) / 4
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # a hot vector counts once
    n, sums, deviations, e, v, trace, good = plain(rows, 9)
    got = whiten(make(spark, rows)).collect()
    assert len(got) == 4 * len(rows)
    assert {r.n for r in got} == {n} == {900}
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == deviations
    for k in range(4):
        own = {r.vec_id: r for r in got if r.component == k + 1}
        assert own[0].explained == pytest.approx(e[k] / trace, rel=1e-9)
        want = {i: (np.array(x) - np.array(sums) / n) @ v[:, k] / math.sqrt(e[k]) for i, x in good}
        sign = 1 if want[0] * own[0].whitened > 0 else -1
        assert all(own[i].whitened == pytest.approx(sign * want[i], abs=1e-7) for i in want)
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() < 1e-9


def test_odd_vectors(spark):
    rows = [(1, [0.5, 1.0]), (2, [-0.25, 2.0]), (3, [0.1, -1.5]), (None, [0.5, 1.0]), (1, [0.5, 1.0]), (4, None), (5, []), (6, [None, 1.0]), (7, [math.nan, 1.0]), (8, [math.inf, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [0.0, 0.0])]
    got = whiten(make(spark, rows)).collect()
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == [1, 2, 3, 10]
    assert {r.component for r in got} == {1, 2} and {r.n for r in got} == {4}
    assert len(got) == 2 * 6
    assert {r.identity_error < 1e-9 for r in got} == {True}
    assert whiten(make(spark, rows[:0])).collect() == []
    assert whiten(make(spark, [(1, None), (2, [])])).collect() == []


def test_without_variance(spark):
    got = whiten(make(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, 0.0, 0.0)}
    line = whiten(make(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert {r.whitened is None for r in line if r.component == 2} == {True}
    assert {r.whitened is None for r in line if r.component == 1} == {False}


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([[3e7, 1.0], [-2e7, 5.0], [1e6, -4.0]])]
    n, _, deviations, *_ = plain(rows, 2)
    got = whiten(make(spark, rows, SCHEMA.replace("float", "double"))).collect()
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == [(i, d if d < 1 << 63 else None) for i, d in deviations]
    assert whiten(make(spark, [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], SCHEMA.replace("float", "double"))).count() == 6
