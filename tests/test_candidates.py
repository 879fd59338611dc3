"""Candidate models, context swaps and regret against plain versions."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline import dims
from touchline.operators import candidates, lineup, models, regret


def plain_logistic(x, y, c):
    """Newton's method for one model on standardised features."""
    mean, scale = x.mean(axis=0), x.std(axis=0, ddof=1)
    scale = np.where(scale == 0, 1, scale)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, free = np.zeros(z.shape[1]), np.append(np.ones(x.shape[1]) / c, 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(free + 1e-12), z.T @ (p - y) + free * w)
    return lambda v: 1 / (1 + np.exp(-(np.hstack([(v - mean) / scale, np.ones((len(v), 1))]) @ w)))


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = (r.random(600) < 1 / (1 + np.exp(-(x[:, 0] + 0.3 * (x[:, 1] - 3))))).astype(float)
    return [(int(i), "ab"[i % 2], *map(float, v), 7.0, float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]


SCHEMA = "i int, grp string, u double, v double, w double, same double, y double"


def test_many_fits_equal_single_ones(spark, rows):
    df = spark.createDataFrame([*rows, (900, "a", None, 1.0, 1.0, 7.0, 1.0), (901, "one", 0.0, 0.0, 0.0, 7.0, 1.0), (902, None, 0.0, 1.0, 1.0, 7.0, None)], SCHEMA).repartition(5)
    sets = {"one": ["u"], "two": ["u", "v"], "all": ["u", "v", "w", "same"]}
    fits = candidates.fit(df, sets, "y", c=2.0, group="grp")
    assert set(fits) == set(itertools.product(sets, (None, "a", "b")))  # a group of one class has no model
    data = [*rows, (901, "one", 0.0, 0.0, 0.0, 7.0, 1.0)]
    for (name, group), own in fits.items():
        at = [SCHEMA.split(", ").index(next(s for s in SCHEMA.split(", ") if s.startswith(f + " "))) for f in sets[name]]
        part = [d for d in data if group in (None, d[1])]
        x, y = np.array([[d[k] for k in at] for d in part]), np.array([d[-1] for d in part])
        want = plain_logistic(x, y, 2.0)(x)
        got = {r.i: r.p for r in spark.createDataFrame(part, SCHEMA).select("i", own.chance().alias("p")).collect()}
        assert [got[d[0]] for d in part] == pytest.approx(want, abs=1e-7)


def plain_auc(p, y):
    pairs = [(a > b) + 0.5 * (a == b) for a, s in zip(p, y, strict=True) if s for b, t in zip(p, y, strict=True) if not t]
    return sum(pairs) / len(pairs) if pairs else None


def test_candidates_are_compared_by_group_and_over_all(spark, rows):
    df = spark.createDataFrame([(*d[:2], round(1 / (1 + math.exp(-d[2])), 1), d[-1]) for d in rows[:200]] + [(999, "one", 0.5, 1.0)], "i int, grp string, p double, y double")
    told = {"p": F.col("p"), "flat": F.lit(0.5), "some": F.when(F.col("i") < 100, F.col("p"))}
    got = {(r.model, r.grp): r for r in candidates.compare(df, told, "y", "grp").collect()}
    data = df.collect()
    for (model, group), r in got.items():
        part = [(0.5 if model == "flat" else d.p, d.y) for d in data if group in (None, d.grp) and (model != "some" or d.i < 100)]
        p, y = zip(*part, strict=True)
        assert r.n == len(part)
        assert r.auc == (pytest.approx(plain_auc(p, y)) if 0 < sum(y) < len(y) else None)
        clipped = [min(1 - 1e-4, max(1e-4, q)) for q in p]
        assert r.log_loss == pytest.approx(-sum(math.log(q if s else 1 - q) for q, s in zip(clipped, y, strict=True)) / len(y))
        assert r.brier == pytest.approx(sum((q - s) ** 2 for q, s in part) / len(y))
    assert set(got) == {*itertools.product(("p", "flat"), ("a", "b", "one", None)), *itertools.product(("some",), ("a", "b", None))}


def test_bootstraps_share_draws(spark):
    r = random.Random(4)
    rows = [(k % 17, "xy"[k % 2], r.random(), r.random()) for k in range(300)]
    df = spark.createDataFrame(rows, "c int, g string, d double, e double")
    both = {x.g: x for x in models.clustered_bootstraps(df, "c", ["d", "e"], 40, by=["g"]).collect()}
    weights = {(x.c, x.k): x.w for x in spark.range(17).selectExpr("int(id) as c", "explode(sequence(1, 40)) as k").withColumn("w", models.poisson_weights("c", "k", 1)).collect()}
    assert 0.85 < sum(weights.values()) / len(weights) < 1.15 and max(weights.values()) >= 3
    for g, at, name in itertools.product("xy", (2, 3), "de"):
        if (at, name) in ((2, "d"), (3, "e")):
            means = []
            for k in range(1, 41):
                own = [(weights[x[0], k], x[at]) for x in rows if x[1] == g]
                means.append(sum(w * d for w, d in own) / sum(w for w, _ in own))
            assert both[g][f"mean_{name}"] == pytest.approx(np.mean(means)) and both[g][f"spread_{name}"] == pytest.approx(np.std(means))


def test_contexts_are_scored_by_one_fit(spark):
    r = np.random.default_rng(8)
    data = [(int(i), i // 5, "gh"[i % 2], *map(float, r.random(3)), float(r.normal())) for i in range(400)]
    schema = "i int, cluster int, grp string, win double, other double, x double, t double"
    df = spark.createDataFrame(data, schema).withColumn("t", F.col("t") * 0.1 + F.col("win"))
    train, test = df.filter("i < 250"), df.filter("i >= 250")
    contexts = {"own": (F.col("win"), F.lit(0.3), F.lit(0.2)), "other": (F.col("other"), F.lit(0.3), F.lit(0.2)), "flat": (F.lit(0.5), F.lit(0.3), F.lit(0.2))}
    swap = lambda win, loss, draw: {"win": win, "unused": loss + draw}
    got = {(x.grp, x.context): x for x in models.context_swap(train, test, "grp", {"win": 1, "x": 0}, contexts, swap, "t", "cluster", "flat", draws=50).collect()}
    weights = {(x.grp, x.feature): x.weight for x in models.signed_ridge(train, "grp", {"win": 1, "x": 0}, "t").collect()}
    drawn = {(x.c, x.k): x.w for x in spark.range(50, 80).selectExpr("int(id) as c", "explode(sequence(1, 50)) as k").withColumn("w", models.poisson_weights("c", "k", 1)).collect()}
    for g in "gh":
        part = [x for x in test.collect() if x.grp == g]
        error = lambda x, win: (x.t - weights[x.grp, "intercept"] - weights[x.grp, "win"] * win - weights[x.grp, "x"] * x.x) ** 2
        wins = {"own": lambda x: x.win, "other": lambda x: x.other, "flat": lambda x: 0.5}
        for name, win in wins.items():
            own, flat = [error(x, win(x)) for x in part], [error(x, 0.5) for x in part]
            assert got[g, name].mse == pytest.approx(np.mean(own)) and got[g, name].n == len(part)
            assert got[g, name].gain == pytest.approx(np.mean(np.array(flat) - own))
            means = [sum(drawn[x.cluster, k] * (f - o) for x, o, f in zip(part, own, flat, strict=True)) / sum(drawn[x.cluster, k] for x in part) for k in range(1, 51)]
            assert got[g, name].spread == pytest.approx(np.std(means), abs=1e-12)
    assert got["g", "flat"].gain == 0 and got["g", "own"].gain > 0


def test_groups_are_compared_on_the_same_ranks(spark):
    """Rows that count for groups so many times fare as rows of each group."""
    rows = spark.range(600).selectExpr("id % 2 as y", "id * 7 % 50 / 50d as a", "if(id % 5 > 0, id * 3 % 20 / 20d, null) as b", "cast(id % 3 as long) as n_x", "cast(id % 4 as long) as n_z", "0L as n_none")
    told = {"A": F.col("a"), "B": F.col("b")}
    got = candidates.compare_groups(rows, told, "y", "g", {"x": "n_x", "z": "n_z", "none": "n_none"}).collect()
    each = rows.selectExpr("y", "a", "b", "explode(map('x', n_x, 'z', n_z)) as (g, w)").filter("w > 0")
    want = candidates.compare(each, told, "y", "g", weight="w").collect()
    key = lambda r: (r.model, r.g or "")
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(want, key=key)] and len(got) == 6
    for r, s in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert r.n == s.n and all(abs(r[c] - s[c]) < 1e-12 for c in ("auc", "log_loss", "brier"))


def test_candidates_are_dealt_once_for_all_groups(spark):
    """A row of a line and candidate goes through one exchange, however many groups its players are of."""
    rows = spark.range(1000).selectExpr("id % 2 as y", "id / 1000d as a", *(f"1L as n{j}" for j in range(4)))
    seen = []
    own, models.running_counts = models.running_counts, lambda df, *a, **b: seen.append(df) or own(df, *a, **b)
    try:
        candidates.compare_groups(rows, {"A": F.col("a"), "B": F.col("a") / 2}, "y", "g", {str(j): f"n{j}" for j in range(4)}).collect()
    finally:
        models.running_counts = own
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert len(seen) == 1 and seen[0].count() == 2000 and plan.count("Exchange ") == 1


def test_running_counts_within_groups(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), float(v), r.randrange(5)) for v in r.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = {(x.g, x.v): x.before_n for x in models.running_counts(df, "v", "n", by=["g"]).collect()}
    assert got == {(g, v): sum(m for h, w, m in rows if h == g and w < v) for g, v, _ in rows}


# --- regret


def test_assignments_are_the_best_ones():
    r = np.random.default_rng(1)
    worth = r.normal(size=(300, 3, 6)) * 10
    worth[r.random(worth.shape) < 0.35] = -np.inf
    total, team = regret.assign(worth)
    for s in range(len(worth)):
        best = max(sum(worth[s, i, p] for i, p in enumerate(own)) for own in itertools.permutations(range(6), 3))
        assert total[s] == pytest.approx(best) if np.isfinite(best) else total[s] == -np.inf
        assert len(set(team[s])) == 3


SQUAD = "squad_id long, k int, player_id long, positions array<string>, total double, base_rating double, start_prob double"
LINE = ["GK", "GK", "CB", "CB", "CB", "CB", "RB", "LB", "WB", "WB", "DM", "CM", "CM", "W", "AM", "FW", "FW", "ST", "ST"]


def squads(n=6):
    out = []
    for s in range(n):
        r = random.Random(s)
        out += [(s, k, 100 * s + k, [p], r.uniform(0, 40), r.uniform(6.5, 8.5), r.uniform(0.3, 1)) for k, p in enumerate(LINE[: len(LINE) - (6 if s == 5 else 0)])]
    return out


def test_no_line_up_exceeds_its_bound(spark):
    rows = spark.createDataFrame(squads(), SQUAD)
    got = regret.bounds(rows).collect()
    assert got and all(r.score <= r.bound + 1e-6 for r in got)
    assert {(r.squad_id, r.formation): r.score for r in got} == {(r.squad_id, r.formation): r.score for r in lineup.formation_lineups(rows).collect()}
    assert np.mean([r.bound - r.score for r in got]) < 12  # the climb ends close to the bound
    for s in range(2):  # random line-ups stay below it, too
        own = [x for x in squads() if x[0] == s]
        top = {r.formation: r.bound for r in got if r.squad_id == s}
        r = random.Random(s)
        for formation in top:
            slots = dims.SLOTS[formation]
            for _ in range(300):
                free, score, line = own[2:], max(x[4] for x in own[:2]), []
                for slot in slots:
                    fits = [(x, max(dims.MALUS[p][x[3][0]] for p in slot if x[3][0] in dims.MALUS[p])) for x in free if any(x[3][0] in dims.MALUS[p] for p in slot)]
                    if not fits:
                        break
                    x, m = r.choice(fits)
                    free = [y for y in free if y is not x]
                    score += x[4] if m == 0 else max(0, x[4] + m * dims.UNITS_PER_POINT * x[6])
                    if set(slot) <= set(dims.BACK_LINE):
                        line.append(x[5])
                else:
                    mean = sum(line) / len(line)
                    score += dims.UNITS_PER_POINT * (0 if mean < 7 else min(5, math.floor((mean - 7) / 0.25 + 1e-9) + 1))
                    assert score <= top[formation] + 1e-6


def test_regret_equals_a_plain_version(spark):
    r = random.Random(5)
    own = squads()
    results = [(x[0], x[2], r.random() < 0.7, r.uniform(3, 12) if r.random() < 0.95 else None, r.uniform(5.5, 8.5) if r.random() < 0.9 else None) for x in own]
    rows, told = spark.createDataFrame(own, SQUAD), spark.createDataFrame(results, "squad_id long, player_id long, played boolean, points double, base double")
    brought = {x[1]: x for x in results}

    def worth(line_up):
        slots = dims.SLOTS[line_up.formation]
        total = sum(brought[i][3] + m for i, m in zip(line_up.ids, line_up.malus, strict=True) if brought[i][2] and brought[i][3] is not None)
        line = [(brought[i][4] or 0.0) if brought[i][2] else 0.0 for i, s in zip(line_up.ids[1:], slots, strict=True) if set(s) <= set(dims.BACK_LINE)]
        mean = sum(line) / len(line) if line else 0
        return total + (0 if mean < 7 else min(5, math.floor((mean - 7) / 0.25 + 1e-9) + 1))

    before = {(x.squad_id, x.formation): x for x in lineup.formation_lineups(rows).collect()}
    then = []
    for x in own:
        _, _, played, points, base = brought[x[2]]
        then.append((*x[:4], max(0.01, (points - 5) * 15) if played and points is not None else 0.01, 6.0 if base is None else base, 1.0))
    after = {(x.squad_id, x.formation): x for x in lineup.formation_lineups(spark.createDataFrame(then, SQUAD)).collect()}
    got = {(x.squad_id, x.formation): x for x in regret.formation_regret(rows, told).collect()}
    assert set(got) == set(before) and {k[0] for k in got} == set(range(5))
    for k, x in got.items():
        assert (x.engine, x.hindsight) == (pytest.approx(worth(before[k])), pytest.approx(worth(after[k])))
    parts = {x.squad_id: x for x in regret.decompose(regret.formation_regret(rows, told)).collect()}
    for s, x in parts.items():
        mine = {f: (worth(before[s, f]), worth(after[s, f]), before[s, f].score) for q, f in before if q == s}
        pick = max(mine, key=lambda f: (mine[f][2], -list(dims.SLOTS).index(f)))
        assert x.formation == pick
        assert [x.engine, x.best_formation, x.best_players, x.both, x.mean_formation] == pytest.approx([mine[pick][0], max(m[0] for m in mine.values()), mine[pick][1], max(m[1] for m in mine.values()), np.mean([m[0] for m in mine.values()])])
        assert x.best_formation >= x.engine
    mean = regret.regret_means(spark.createDataFrame(list(parts.values()))).first()
    assert mean.n == 5 and mean.engine == pytest.approx(np.mean([x.engine for x in parts.values()]))


def test_bounds_look_only_where_they_can_fall(monkeypatch):
    r = np.random.default_rng(8)
    table, squads, players = list(dims.SLOTS.values()), 40, 26
    asked, assign = [], regret.assign
    monkeypatch.setattr(regret, "assign", lambda worth: asked.append(len(worth)) or assign(worth))
    for slots in table[:2]:
        plays = np.zeros((squads, players, len(lineup.POSITIONS)), bool)
        plays[np.arange(squads)[:, None], np.arange(players), (np.arange(players) + r.integers(0, 3, (squads, 1))) % len(lineup.POSITIONS)] = True
        keeper = plays[:, :, lineup.POSITIONS.index("GK")]
        group = lineup.Squads(plays, keeper, r.uniform(5, 55, (squads, players)), r.uniform(6, 8.4, (squads, players)), np.ones((squads, players)), slots)
        asked.clear()
        got = regret.tier_bound(group)
        assert sum(asked) < squads * (1 + 5 * regret.STEPS) / 2
        least, _ = assign(group.worth)
        want = least.copy()
        for tier in range(1, 6):
            over = np.where(group.back[None, :, None], group.base[:, None] - (7 + 0.25 * (tier - 1) - 1e-9), 0.0)
            low, high, best = np.zeros(squads), np.full(squads, regret.PRICE), least.copy()
            for _ in range(regret.STEPS):
                price = (low + high) / 2
                total, team = assign(group.worth + price[:, None, None] * over)
                best = np.minimum(best, total)
                with np.errstate(invalid="ignore"):
                    has = over[np.arange(squads)[:, None], np.arange(team.shape[1]), team].sum(axis=1) >= 0
                low, high = np.where(has, low, price), np.where(has, price, high)
            want = np.maximum(want, best + tier * dims.UNITS_PER_POINT)
        assert np.isfinite(want).any() and got == pytest.approx(want, abs=1e-9)


def test_slots_are_found_within_players(spark):
    rows = [(1, 7, ["CB", "RB"]), (1, 8, ["ST", None]), (1, 9, []), (1, 9, ["XX"]), (2, 7, None), (1, 7, ["CM"])]
    out = lineup.slot_fits(spark.createDataFrame(rows, "squad_id long, player_id long, positions array<string>"))
    want = {}
    for squad, player, own in rows:
        for f, slots in dims.SLOTS.items():
            for i, slot in enumerate(slots):
                for m in (dims.MALUS[s][p] for s in slot for p in own or [] if p in dims.MALUS[s]):
                    want[squad, f, i, player] = max(m, want.get((squad, f, i, player), m))
    got = out.collect()
    assert {tuple(x)[:4]: x.malus for x in got} == want and len(got) == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Aggregate [squad_id")  # the slots of a player are made after the last grouping


def test_value_of_features_is_told_by_moments(spark):
    """Gains and spreads from sums of products, of parts of clusters, equal those of the rows' own errors."""
    r = np.random.default_rng(9)
    data = [(int(i), i // 5, "gh"[i % 2], int(r.integers(1, 4)), *map(float, r.random(3))) for i in range(400)]
    df = spark.createDataFrame(data, "i int, cluster int, grp string, n_of int, a double, x double, e double").withColumn("t", 6 + F.col("a") + 3 * F.col("x") + F.col("e"))
    train, test = df.filter("i < 250"), df.filter("i >= 250")
    base, extra = {"a": 1}, {"x": 1}
    fits = [({(w.grp, w.feature): w.weight for w in models.signed_ridge(train, "grp", f, "t", weight="n_of").collect()}, f) for f in (base, {**base, **extra})]
    error = lambda z, w, f: (z.t - w[z.grp, "intercept"] - sum(w[z.grp, k] * z[k] for k in f)) ** 2
    parts = models.moments(df.withColumn("part", F.col("i") % 3), ["grp", "cluster", "part"], ["a", "x", "t"], "n_of")
    by_parts = models.value_of_moments(parts.filter("cluster < 50"), parts.filter("cluster >= 50"), "grp", base, extra, "t", "cluster", draws=40)
    drawn = {(x.c, x.k): x.w for x in spark.range(50, 80).selectExpr("int(id) as c", "explode(sequence(1, 40)) as k").withColumn("w", models.poisson_weights("c", "k", 1)).collect()}
    for got in (by_parts, models.incremental_value(train, test, "grp", base, extra, "t", "cluster", draws=40, weight="n_of")):
        for row in got.collect():
            own = [(z.cluster, z.n_of, error(z, *fits[0]) - error(z, *fits[1])) for z in test.collect() if z.grp == row.grp]
            n = sum(k for _, k, _ in own)
            means = [sum(drawn[c, d] * k * g for c, k, g in own) / sum(drawn[c, d] * k for c, k, _ in own) for d in range(1, 41)]
            assert row.n == n and row.gain == pytest.approx(sum(k * g for _, k, g in own) / n) and row.spread == pytest.approx(np.std(means))


def test_own_goals_are_valued_without_keeping_lines(spark, monkeypatch):
    """What is kept for the fits and draws is a row for each side of a match, not one for each line."""
    from touchline.plans import registry  # before its modules, which read each other
    from touchline.plans import games

    kept = []
    monkeypatch.setattr(games.landing, "keep_columns", lambda df, f=games.landing.keep_columns: kept.append(f(df)) or kept[-1])
    registry.QUERIES["m08_incremental_value"](spark, "/root/testdata/sf0.001")
    assert kept and 0 < kept[0].count() <= 2 * games.t.matches(spark, "/root/testdata/sf0.001").count()
