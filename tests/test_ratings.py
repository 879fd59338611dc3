"""Ratings: the walk, scans that need no walk, and keyed stream state with late, re-dated and repeated matches."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import ratings, scans
from touchline.streaming import ratings as streamed

M = "match_id long, dt timestamp_ntz, league int, season int, h int, a int, hs int, as_ int"


def games(n, seed=2, teams=8):
    r = random.Random(seed)
    out = []
    for i in range(n):
        d = datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i * 3)
        h, a = r.sample(range(teams), 2)
        out.append((i, d, i % 2, d.year, h + 10 * (i % 2), a + 10 * (i % 2), r.randrange(5), r.randrange(4)))
    return out


def states(df):
    return sorted(tuple(r) for r in df.collect())


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)


class Landed:
    """Arrivals as files, each taken by a query that starts from the checkpoint of the one before."""

    def __init__(self, spark, folder, late, **k):
        self.spark, self.late, self.source, self.checkpoint, self.k = spark, late, f"{folder}/in", f"{folder}/check", k

    def take(self, rows):
        self.spark.createDataFrame(rows, M).coalesce(1).write.mode("append").parquet(self.source)
        stream = self.spark.readStream.schema(M).parquet(self.source)
        streamed.keep_ratings(stream, self.checkpoint, self.late, once=True, **self.k).awaitTermination()
        return states(streamed.kept(self.spark, self.checkpoint))


def test_a_stream_in_order_equals_the_batch_and_takes_each_id_once(spark, tmp_path):
    rows = games(60)
    landed = Landed(spark, tmp_path, "append")
    landed.take(rows[:30])
    first = landed.take(rows[20:])  # ten matches come twice
    close(first, states(ratings.state_after(spark.createDataFrame(rows, M))))
    match = rows[25]
    odd = [(match[0], datetime.datetime(2021, 9, 9), *match[2:]), (rows[3][0], None, *rows[3][2:]), (None, rows[5][1], *rows[5][2:]), (900, rows[5][1], 0, 2020, 1, 2, None, 3)]
    assert landed.take(odd) == first  # another month, no date, no id, no score


@pytest.mark.parametrize("late", ["rewind", "append"])
def test_late_matches(spark, tmp_path, late):
    rows = games(80)
    arrivals = [rows[:20] + rows[30:50], rows[50:60] + [(500, None, 1, 2020, 11, 12, 3, 0)], rows[20:30] + rows[60:]]
    landed = Landed(spark, tmp_path, late)
    for part in arrivals:
        got = landed.take(part)
    if late == "rewind":
        want = ratings.state_after(spark.createDataFrame(sum(arrivals, []), M))
    else:
        want = None
        for part in arrivals:
            want = ratings.state_after(spark.createDataFrame(part, M), want)
    close(got, states(want))


def test_the_two_readings_of_late_matches_differ(spark, tmp_path):
    rows = games(40)
    got = [Landed(spark, tmp_path / late, late) for late in ("rewind", "append")]
    for landed in got:
        landed.take(rows[:10] + rows[20:])
    a, b = (landed.take(rows[10:20]) for landed in got)
    assert a != b


def test_a_stream_goes_on_from_a_batch(spark, tmp_path):
    rows = games(50)
    begun = ratings.state_after(spark.createDataFrame(rows[:30], M))
    got = Landed(spark, tmp_path, "rewind", state=begun).take(rows[30:])
    close(got, states(ratings.state_after(spark.createDataFrame(rows, M))))


def test_the_state_is_asked_for_neighbouring_ids_at_once():
    class Asked(dict):
        calls = 0

        def containsKey(self, key):  # noqa: N802
            Asked.calls += 1
            return key in self

        getValue, updateValue = dict.__getitem__, dict.__setitem__  # noqa: N815

    league = streamed.LeagueRatings(False)
    league.taken = Asked()
    fresh = lambda *ids: league._fresh(np.array(ids)).tolist()
    assert fresh(*range(0, 8000, 2)) == [True] * 4000 and Asked.calls == 2
    assert fresh(7, 8, 4095, 4096, -1, 1 << 40, 9000) == [True, False, True, False, True, True, True]
    assert fresh(-1, -4097, 1 << 40, (1 << 40) + 4096, 7) == [False, True, False, True, False]


def test_unknown_reading_is_refused(spark):
    with pytest.raises(ValueError, match="rewound"):
        streamed.rated(None, "never")


@pytest.mark.parametrize("ranges", [1, 7])
def test_scans_equal_the_walk(spark, monkeypatch, ranges):
    dealt = scans.before
    monkeypatch.setattr(ratings.scans, "before", lambda *a: dealt(*a, ranges=ranges))
    df = spark.createDataFrame([*games(700, teams=5), (9000, None, 0, 2019, 1, 2, 4, 4), (9001, None, 0, 2020, 1, 2, None, 4)], M)
    walk = {r.match_id: (r.lam_h, r.lam_a) for r in ratings.replay(df).collect()}
    got = {r.match_id: (r.lam_h, r.lam_a) for r in ratings.goals_before(df).collect()}
    assert set(got) == set(walk) and len(got) == 701
    assert all(got[k] == pytest.approx(walk[k], abs=1e-9) for k in walk)


def test_scans_of_one_key_are_dealt_to_many_tasks(spark):
    rows = [(i, float((i * 7) % 11), 1 + i // 50, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, v double, mark int, i int").withColumn("k", F.lit(1))
    kinds = {"mean": scans.Mean("v", 0.25), "n": scans.Count("mark", 6), "x": scans.Affine("half", "v", 3.0)}
    out = scans.before(df.withColumn("half", F.lit(0.5)), ["k"], ["i"], kinds, ranges=8)
    assert out.select(F.spark_partition_id()).distinct().count() > 3
    mean, n, x, last = None, 0, 3.0, 1
    for r in sorted(out.collect(), key=lambda r: r.i):
        n = min(n, 6) if r.mark != last else n
        assert (r.mean, r.n, r.x) == (pytest.approx(mean) if mean is not None else None, n, pytest.approx(x))
        mean = r.v if mean is None else mean + 0.25 * (r.v - mean)
        n, x, last = n + 1, 0.5 * x + r.v, r.mark
    assert scans.before(df.limit(0).withColumn("half", F.lit(0.5)), ["k"], ["i"], kinds).collect() == []


def test_expected_goals_stand_for_goals(spark):
    df = spark.createDataFrame(games(30), M)
    xg = df.withColumn("hx", F.when(F.col("match_id") % 2 == 0, 2.5)).withColumn("ax", F.lit(None).cast("double"))
    a, b = (sorted((r.match_id, r.lam_h) for r in ratings.replay(x).collect()) for x in (df, xg))
    assert a != b
    close(sorted((r.match_id, r.lam_h) for r in ratings.goals_before(xg).collect()), b)


def test_refresh_begins_with_the_last_season_and_takes_each_match_once(spark):
    rows = [(*r, 2.0 if r[0] % 3 else None, 0.5) for r in games(240)]
    schema = M + ", hx double, ax double"
    season = lambda y, upto=10**6: spark.createDataFrame([r for r in rows if r[3] == y and r[0] < upto] + [(10**7, None, 0, y, 1, 2, None, None, None, None)], schema)
    state, processed = ratings.refresh(season(2021, 150).union(season(2021, 150)), season(2020))
    state, processed = ratings.refresh(season(2021), season(2020), state, processed)
    assert processed.count() == len([r for r in rows if r[3] in (2020, 2021)]) == processed.distinct().count()
    want = ratings.state_after(spark.createDataFrame([(*r[:8], *((None, None) if r[3] == 2020 else r[8:])) for r in rows if r[3] in (2020, 2021)], schema))
    close(states(state), states(want))
    again, _ = ratings.refresh(season(2021), season(2020), state, processed)
    close(states(again), states(want))
