"""Operators on small literal tables: leaks, transfers, resolution, freshness, ratings, line-ups, streams."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from touchline import dims
from touchline.operators import freshness, joins, lineup, models, ratings, windows
from touchline.sources import feeds, tables

M = "match_id long, dt timestamp_ntz, league int, season int, h int, a int, hs int, as_ int"


def games(n=60, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        h, a = r.sample(range(5), 2)
        out.append((i, dt.datetime(2020, 1, 1) + dt.timedelta(days=i // 2 * 12), i % 2, 2020 + (i // 2 * 12) // 365, h, a, r.randrange(5), r.randrange(4)))
    return out


def test_standings_and_form_don_t_see_their_match(spark):
    rows = games()
    changed = [x if i < 40 else (*x[:6], 9, 0) for i, x in enumerate(rows)]
    for f in (windows.standings_before, windows.team_form, windows.points_per_game):
        a, b = (sorted(tuple(x) for x in f(tables.team_matches(spark.createDataFrame(r, M))).filter("match_id <= 40").collect()) for r in (rows, changed))
        assert a == b


def test_absent_rows_end_with_a_transfer(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    numbers = spark.createDataFrame([(10 * team + k, t(2 * k + team), 1, 2020, team, k) for team in (1, 2) for k in range(6)], "match_id long, dt timestamp_ntz, league int, season int, team int, team_no int")
    # seen for team 1 in its first match, for team 2 in that team's third
    apps = spark.createDataFrame([(10, t(1), 1, 2020, 7, 1), (22, t(6), 1, 2020, 7, 2)], "match_id long, dt timestamp_ntz, league int, season int, player_id int, team int")
    got = {(r.team, r.match_id) for r in windows.absent_rows(apps, numbers).collect()}
    assert got == {(1, 11), (1, 12), (2, 23), (2, 24), (2, 25)}


def plain_elo(rows):
    """An independent fold over one global pass."""
    elo, season, out = {}, {}, {}
    for i, d, league, s, h, a, hs, as_ in sorted(rows, key=lambda x: (x[1], x[0])):
        for t in ((league, h), (league, a)):
            if t in elo and season[t] != s:
                elo[t] = 1500 + 0.7 * (elo[t] - 1500)
            elo.setdefault(t, 1500.0)
            season[t] = s
        x, y = elo[league, h], elo[league, a]
        out[i] = x - y
        gap = abs(hs - as_)
        d = 18 * (1 if gap < 2 else 1.5 if gap == 2 else (11 + gap) / 8) * ((hs > as_) + 0.5 * (hs == as_) - 1 / (1 + 10 ** (-(x - y + 55) / 400)))
        elo[league, h] += d
        elo[league, a] -= d
    return out


def test_replay_equals_a_plain_fold_and_batches(spark):
    rows = games(120)
    df = spark.createDataFrame(rows, M)
    got = {r.match_id: r.elo_diff for r in ratings.replay(df).collect()}
    assert got == pytest.approx(plain_elo(rows))
    whole = sorted(tuple(r) for r in ratings.state_after(df).collect())
    parts = ratings.state_after(df.filter("match_id >= 60"), ratings.state_after(df.filter("match_id < 60")))
    assert [x[:2] for x in whole] == [x[:2] for x in sorted(tuple(r) for r in parts.collect())]
    for a, b in zip(whole, sorted(tuple(r) for r in parts.collect()), strict=True):
        assert a == pytest.approx(b)


def test_chances_sum_to_one_and_favour_the_stronger(spark):
    df = spark.createDataFrame([(300.0, 2.0, 0.8), (0.0, 1.4, 1.2), (-300.0, 0.8, 2.0)], "elo_diff double, lam_h double, lam_a double")
    p = ratings.outcome_chances(df).collect()
    assert all(r.p_home + r.p_draw + r.p_away == pytest.approx(1) for r in p)
    assert p[0].p_home > p[1].p_home > p[2].p_home


def squad(seed, n=14):
    r = random.Random(seed)
    line = ["GK", "GK", "CB", "CB", "CB", "CB", "RB", "LB", "WB", "WB", "DM", "CM", "CM", "W", "AM", "FW", "FW", "ST", "ST"]
    return [(1, k, 100 + k, [p] if r.random() < 0.7 else [p, r.choice(line[2:])] if p != "GK" else [p], r.uniform(0, 40), r.uniform(6, 8.5), r.uniform(0.3, 1)) for k, p in enumerate(line)]


SQUAD = "squad_id long, k int, player_id long, positions array<string>, total double, base_rating double, start_prob double"


def plain_worth(player, slot):
    """A player's worth in a slot, or None where no position fits."""
    _, _, _, positions, total, _, start = player
    fits = [m for taken in slot for p, m in dims.MALUS[taken].items() if p in positions]
    return None if not fits else total if max(fits) == 0 else max(0.0, total + max(fits) * 15 * start)


def plain_score(keeper, team, slots):
    back = [p[5] for p, s in zip(team, slots, strict=True) if set(s) <= {"RB", "CB", "LB"}]
    mean = sum(back) / len(back) if back else 0
    bonus = 0 if mean < 7 else min(5, math.floor((mean - 7) / 0.25 + 1e-9) + 1)
    return keeper[4] + sum(plain_worth(p, s) for p, s in zip(team, slots, strict=True)) + 15 * bonus


def test_line_ups_are_valid_and_local_optima(spark):
    rows = [(seed, *r[1:]) for seed in range(3) for r in squad(seed)]
    got = lineup.formation_lineups(spark.createDataFrame(rows, SQUAD)).collect()
    assert {r.squad_id for r in got} == {0, 1, 2}
    for r in got:
        players = {p[2]: p for p in rows if p[0] == r.squad_id}
        slots, keeper, team = dims.SLOTS[r.formation], players[r.ids[0]], [players[i] for i in r.ids[1:]]
        assert len(set(r.ids)) == 11 and keeper[4] == max(p[4] for p in players.values() if p[3] == ["GK"])
        assert all(plain_worth(p, s) is not None for p, s in zip(team, slots, strict=True))
        assert plain_score(keeper, team, slots) == pytest.approx(r.score)
        bench = [p for i, p in players.items() if i not in r.ids]
        for i in range(10):
            moves = [team[:i] + [p] + team[i + 1 :] for p in bench]
            for j in range(i + 1, 10):
                swapped = list(team)
                swapped[i], swapped[j] = team[j], team[i]
                moves.append(swapped)
            for move in moves:
                if all(plain_worth(p, s) is not None for p, s in zip(move, slots, strict=True)):
                    assert plain_score(keeper, move, slots) <= r.score + 1e-6
    best = {r.squad_id: r for r in lineup.best_lineups(spark.createDataFrame(got)).collect()}
    assert all(best[k].score == max(r.score for r in got if r.squad_id == k) for k in best)


def test_small_formation_against_all_teams(spark, monkeypatch):
    slots = [["CB"], ["DM", "CM"], ["FW", "ST"]]
    monkeypatch.setitem(dims.SLOTS, "tiny", slots)
    rows = []
    for seed in range(20):
        r = random.Random(seed)
        rows.append((seed, 0, 0, ["GK"], 5.0, 7.0, 1.0))
        rows += [(seed, i, i, [r.choice(["CB", "DM", "CM", "ST", "FW"])], r.uniform(0, 30), r.uniform(6, 8.5), 1.0) for i in range(1, 8)]
    got = {r.squad_id: r for r in lineup.formation_lineups(spark.createDataFrame(rows, SQUAD), ["tiny"]).collect()}
    assert len(got) > 10
    for seed in range(20):
        own = [p for p in rows if p[0] == seed]
        teams = [c for c in itertools.permutations(own[1:], 3) if all(plain_worth(p, s) is not None for p, s in zip(c, slots, strict=True))]
        if seed not in got:  # a slot ran out of players while it was filled
            continue
        assert got[seed].score <= max(plain_score(own[0], c, slots) for c in teams) + 1e-9
        assert plain_score(own[0], [own[i] for i in got[seed].ids[1:]], slots) == pytest.approx(got[seed].score)


def test_staged_match(spark):
    players = spark.createDataFrame([(1, "nicolas paz", "como", 1), (2, "rodri", "city", 1), (3, "joao felix", "milan", 1), (4, "no one", "x", 1)], "player_id int, name string, club string, block int")
    natives = spark.createDataFrame(
        [(10, "nico paz", "paz", "nico", "como", 1), (11, "luis paz", "paz", "luis", "roma", 1), (12, "pablo rodri", "pablo rodri", "", "city fc", 1), (13, "joao felix", "felix", "joao", "milan", 1)],
        "native_id int, full string, last string, first string, club_name string, block int",
    )
    assert {tuple(r) for r in joins.staged_match(players, natives, ["block"]).collect()} == {(1, 10), (2, 12), (3, 13)}


def test_overlay_and_prior(spark):
    team = spark.createDataFrame([(1, 5.0, 1), (2, 6.0, 2)], "id int, rating double, goals int")
    rated = spark.createDataFrame([(1, None), (9, 9.0)], "id int, rating double")
    extra = spark.createDataFrame([(2, None, 7)], "id int, rating double, goals int")
    assert {tuple(r) for r in joins.overlay(team, rated, extra, "id", ["rating"], ["rating", "goals"]).collect()} == {(1, None, 1), (2, 6.0, 7)}


def test_freshness(spark):
    df = spark.createDataFrame([(500, True, False), (5000, True, False), (50000, True, False), (500, False, False), (40000, True, True), (500, True, True), (None, True, False)], "age long, has boolean, forced boolean")
    got = df.select(freshness.action(F.col("age"), F.lit(1000), F.lit(10000), F.col("has"), F.col("forced"))).collect()
    assert [r[0] for r in got] == ["serve", "refresh", "fetch", "fetch", "fetch", "serve", "fetch"]
    old, new = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, at int, v string"), spark.createDataFrame([(2, 30, "c"), (3, 40, "d")], "k int, at int, v string")
    assert {tuple(r) for r in freshness.upsert(old, new, ["k"], "at").collect()} == {(1, 10, "a"), (2, 20, "c"), (3, 40, "d")}
    assert freshness.guarded(old, new.limit(0)).count() == 2
    rows = spark.createDataFrame([(1, [(5, "x"), (6, "y")])], "k int, players array<struct<id: int, status: string>>")
    assert [p.status for p in freshness.update_member(rows, "players", 6, "status", F.lit("z")).first().players] == ["x", "z"]
    assert freshness.remove_member_field(rows, "players", 5, "status", "string").first().players[0].status is None
    assert freshness.holders(rows, "players", 7).count() == 0


LEAGUE_DOC = """{"matches": {"allMatches": [
 {"id": "1", "roundName": "3", "home": {"id": "7", "name": "A"}, "away": {"id": "8", "name": "B"}, "status": {"utcTime": "2024-01-05T20:00:00Z", "finished": true, "scoreStr": "2 - 1"}},
 {"id": "2", "round": "4", "home": {"id": "7", "name": "A", "score": 5}, "away": {"id": "8", "name": "B", "score": 6}, "status": {"scoreStr": "garbage"}},
 {"id": "3", "home": {"name": "A"}, "away": {"id": "8"}, "status": {}}], "firstUnplayedMatch": {"firstUnplayedMatchId": "2"}},
 "table": [{"data": {"tables": [{"table": {"all": [{"id": "7"}, {"id": "8"}]}}, {"table": {"all": [{"id": "8"}, {"id": "9"}]}}]}}],
 "allAvailableSeasons": ["2024/2025", "2023/2024"], "details": {"selectedSeason": "2024/2025"}}"""


def test_league_feed(spark):
    docs = spark.createDataFrame([(1, LEAGUE_DOC)], "league int, doc string")
    got = [(r.match_id, r.round, r.home_score, r.away_score, r.finished) for r in feeds.league_matches(docs).orderBy("match_id").collect()]
    assert got == [(1, "3", 2, 1, True), (2, "4", 5, 6, False)]
    assert feeds.current_round(docs).first().round == "4"
    assert [(r.position, r.team_id) for r in feeds.table_rows(docs).orderBy("position").collect()] == [(1, 7), (2, 8), (3, 9)]
    assert feeds.seasons(docs).first().previous == "2023/2024"


def test_other_feeds(spark):
    odds = spark.createDataFrame([(1, '{"markets": [{"selections": [{"name": "1", "oddsDecimal": "2.5"}, {"name": "X", "oddsDecimal": "n/a"}]}]}'), (2, '{"markets": []}')], "match_id int, doc string")
    assert [tuple(r) for r in feeds.match_odds(odds).collect()] == [(1, 2.5, None, None)]
    events = spark.createDataFrame([(1, '{"events": [{"type": "Card", "card": "Yellow", "time": 5, "player": {"id": 4, "name": "P"}}, {"type": "Card", "card": "Red"}, {"type": "Goal"}]}')], "match_id int, doc string")
    assert [tuple(r) for r in feeds.card_events(events).collect()] == [(1, 4, "P", "Yellow", 5)]
    squads = spark.createDataFrame(
        [(1, '{"squad": [{"title": "coach", "members": [{"id": 9}]}, {"title": "defenders", "members": [{"id": 3, "name": "D"}]}]}'), (2, '{"lineup": {"starters": [{"id": 5, "positionId": 11}], "subs": [{"id": 5}, {"id": 6, "usualPlayingPositionId": 3}]}}')],
        "team int, doc string",
    )
    assert {(r.team, r.player_id, r.grp) for r in feeds.team_players(squads).collect()} == {(1, 3, "DEF"), (2, 5, "GK"), (2, 6, "FWD")}
    recent = spark.createDataFrame([(1, '[{"id": "a", "rating": "0", "playedInMatch": true, "minutesPlayed": 30, "isHomeTeam": true, "homeScore": 1, "awayScore": 0}, {"id": "b", "rating": "7.1", "playedInMatch": true, "isHomeTeam": false, "homeScore": 1, "awayScore": 1}]')], "player_id int, doc string")
    assert [(r.result, r.rating, r.started) for r in feeds.recent_matches(recent).orderBy("ord").collect()] == [("W", None, False), ("D", 7.1, True)]


def test_signed_ridge_meets_its_conditions(spark):
    r = random.Random(5)
    rows = [(1, a := r.gauss(0, 1), b := r.gauss(2, 3), 2 * a - 0.5 * b + r.gauss(0, 0.1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double")
    free = {x.feature: x.weight for x in models.signed_ridge(df, "g", {"a": 0, "b": 0}, "y", alpha=1e-6).collect()}
    assert free["a"] == pytest.approx(2, abs=0.02) and free["b"] == pytest.approx(-0.5, abs=0.02)
    held = {x.feature: x.weight for x in models.signed_ridge(df, "g", {"a": 1, "b": 1}, "y", alpha=1e-6).collect()}
    assert held["b"] == 0 and held["a"] > 1.5


def test_bootstrap_spread(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, r.gauss(1, 1)) for i in range(400)], "m int, d double")
    got = models.clustered_bootstrap(df, "m", "d").first()
    assert got.mean_diff == pytest.approx(1, abs=0.2) and got.spread == pytest.approx(0.05, abs=0.02)


def test_calibration_merges_equal_edges(spark):
    df = spark.createDataFrame([(0.5, 1.0)] * 50 + [(i / 100, 0.0) for i in range(50)], "p double, y double")
    got = models.calibration(df, "p", "y").collect()
    assert sum(x.n for x in got) == 100 and len(got) == 6


def test_squad_history_with_transfers_against_a_plain_loop(spark):
    r = random.Random(11)
    numbers, apps, count = [], [], {1: 0, 2: 5}
    for i in range(60):
        team = r.choice([1, 2])
        when = dt.datetime(2020, 1, 1) + dt.timedelta(days=i)
        numbers.append((i, when, 1, 2020, team, count[team]))
        count[team] += 1
        for player in (1, 2, 3):
            at = team if player < 3 and player == team else team if player == 3 else None
            if at is not None and r.random() < 0.8:
                minutes = r.choice([0, 25, 90])
                apps.append((i, when, 1, 2020, player, at, int(minutes == 90), minutes, r.choice([None, 6.5, 7.0, 8.0]) if minutes else None))
    no = {x[0]: x[5] for x in numbers}
    want = {}
    for m, *_, p, _team, _s, _min, _r in apps:
        past = [x for x in apps if x[4] == p and x[0] < m]
        near = lambda n: [x for x in past if no[m] - n <= no[x[0]] < no[m]]  # noqa: B023, E731
        rated = [x[8] for x in past if x[8] is not None and x[7] > 30]
        mean = lambda xs: sum(xs) / len(xs) if xs else None
        want[m, p] = (sum(x[6] for x in near(5)), sum(x[7] for x in near(5)), len(near(5)), sum(x[6] for x in near(10)), sum(x[7] for x in near(10)), mean(rated[-5:]), mean(rated[-3:]), no[m] - no[past[-1][0]] if past else None)
    a = spark.createDataFrame(apps, "match_id int, dt timestamp_ntz, league int, season int, player_id int, team int, started int, minutes int, rating double")
    n = spark.createDataFrame(numbers, "match_id int, dt timestamp_ntz, league int, season int, team int, team_no int")
    got = {(x.match_id, x.player_id): tuple(x)[2:] for x in windows.squad_history(a, n).collect()}
    assert got == want


def test_walk_forward_equals_a_fit_for_each_month(spark):
    from pyspark.ml.functions import vector_to_array

    r = random.Random(9)
    rows = []
    for i in range(400):
        x, y = r.gauss(1, 2), r.gauss(0, 1)
        z = x * 0.6 - y + r.gauss(0, 1)
        rows.append((i, f"2020-{i // 80 + 1:02d}", x, y, r.random(), 0 if z > 1 else 1 if z > 0 else 2))
    df = spark.createDataFrame(rows, "id int, month string, x double, y double, noise double, won int")
    got = models.walk_forward(df, "month", {"one": ["x"], "two": ["y", "x"]}, "won", least=100).collect()
    assert {g.month for g in got} == {"2020-03", "2020-04", "2020-05"} and len(got) == 480
    for month in ("2020-03", "2020-05"):
        for name, features in (("one", ["x"]), ("two", ["y", "x"])):
            model = models.logistic(df.filter(F.col("month") < month), features, "won", 1.0, multinomial=True)
            want = {w.id: w.p for w in model.transform(df.filter(F.col("month") == month)).select("id", vector_to_array("probability").alias("p")).collect()}
            for g in got:
                if g.month == month and g.feature_set == name:
                    assert list(g.p) == pytest.approx(want[g.id], abs=2e-3)
    assert models.walk_forward(df.limit(50), "month", {"one": ["x"]}, "won").count() == 0


def test_slopes_of_folds_equal_plain_sums():
    import numpy as np

    r = np.random.default_rng(4)
    x, at, y = np.hstack([r.normal(size=(50, 2)), np.ones((50, 1))]), r.integers(2, 6, 50), r.integers(0, 3, 50)
    folds, w = np.array([1, 3, 4, 7]), r.normal(size=(4, 3, 3))
    got = models.fold_slopes(x, at, y, folds, w)
    assert got.shape == (4, 9 + 3 * 6)  # as many numbers as a set's own features ask for
    upper = np.triu_indices(3)
    for f, fold in enumerate(folds):
        slope, products = np.zeros((3, 3)), np.zeros((3, 6))
        for i in np.flatnonzero(at < fold):
            e = np.exp(w[f] @ x[i])
            p = e / e.sum()
            slope += np.outer(p - (np.arange(3) == y[i]), x[i])
            products += np.outer([p[0] * p[1], p[0] * p[2], p[1] * p[2]], np.outer(x[i], x[i])[upper])
        assert got[f] == pytest.approx(np.concatenate([slope.ravel(), products.ravel()]))
    assert not models.fold_slopes(x, at + 9, y, folds, w).any()


def test_running_counts_and_quantiles_over_ranges(spark):
    import numpy as np

    r = random.Random(2)
    values = [round(r.gauss(0, 1), 1) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counts = {x.v: x.before_n for x in models.running_counts(df.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "v", "n").collect()}
    assert counts == {v: sum(w < v for w in values) for v in values}
    shares = [0.0, 0.1, 0.33, 0.5, 0.999, 1.0]
    got = models.quantiles(df, "v", shares).first()
    assert got.least == min(values) and got.cuts == pytest.approx(np.quantile(values, shares).tolist())


def test_tokens_are_paired_as_by_comparing_all(spark):
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(120)})
    left, right = words[::2], words[1::2]
    make = lambda own: spark.createDataFrame([(1, w) for w in own] + [(1, "")], "league int, token string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for least in (0.643, 0.8):
        want = {(a, b) for a in left for b in right if 1 - distance(a, b) / max(len(a), len(b)) >= least}
        assert want and {(x.a, x.b) for x in joins.similar_tokens(make(left), make(right), ["league"], least).collect()} == want
