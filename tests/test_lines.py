"""Queries on appearances where teams have many players: those alike share their rows until the end."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import verify
from touchline.plans import registry
from touchline.sources import tables as t

SF = "/root/testdata/sf0.001"
NAMES = [
    "w03_season_to_date", "w04_w06_squad_history", "w09_recent_form", "w11_absent_rows", "a02_player_dimension", "a05_season_totals", "a06_a29_team_sums", "a07_group_means", "a11_suggested_start", "a16_presence",
    "a18_distinct_counts", "a20_r_squared", "a22_auc", "a22_log_loss_brier", "a23_calibration", "a32_description", "f35_f37_blended_rate", "f38_start_chance", "j10_p19_appearance_match", "j13_prior_season",
    "j14_goals_on_pitch", "j16_j17_home_away_lookup", "j19_model_by_side", "m00_points", "m01_native_positions", "m02_j11_fit_features", "m03_signed_ridge", "m07_start_candidates", "m07_start_models",
    "p25_p26_time_split", "s18_recent_matches", "s34_match_players", "z02_present_and_absent",
]
#: Queries of a row for each player and match: these shuffle lines alone.
NARROW = ["w03_season_to_date", "w04_w06_squad_history", "j10_p19_appearance_match", "j13_prior_season", "f38_start_chance", "m02_j11_fit_features", "a23_calibration"]


def tables(folder, copies: int) -> str:
    """The smallest tables with the thousand suppliers of sf0.1, ``copies`` times: players of a team leave equal rests by 360."""
    for name in verify.TABLES:
        os.symlink(f"{SF}/{name}.parquet", folder / f"{name}.parquet")
    (folder / "supplier.parquet").unlink()
    duckdb.sql(f"copy (select * replace (s_suppkey + i * 3600 as s_suppkey) from '/root/testdata/sf0.1/supplier.parquet', range({copies}) r(i) where s_suppkey <= 150) to '{folder}/supplier.parquet'")
    return str(folder)


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("many"), 3)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql_with_many_players(spark, many, name):
    db = duckdb.connect()
    for table in verify.TABLES:
        db.sql(f"create view {table} as select * from '{many}/{table}.parquet'")
    df, said = registry.QUERIES[name](spark, many), db.sql(registry.ORACLES[name])
    assert verify.rows_of(df.columns, [tuple(r) for r in df.collect()]) == verify.rows_of(said.columns, said.fetchall())


def shuffled(plan) -> int:
    """Rows that an executed plan wrote to shuffles."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(shuffled(children.apply(i)) for i in range(children.size()))


@pytest.mark.parametrize("name", NARROW)
def test_shuffles_do_not_grow_with_players_alike(spark, tmp_path, name):
    written = []
    for copies in (1, 16):
        (folder := tmp_path / str(copies)).mkdir()
        df = registry.QUERIES[name](spark, tables(folder, copies))
        df.collect()
        written.append(shuffled(df._jdf.queryExecution().executedPlan()))
    assert 0 < written[1] < 2 * written[0]  # a join may be planned otherwise


def test_lines_stand_for_all_players(spark, many):
    lines, apps = t.lines(spark, many), t.appearances(spark, many)
    assert lines.agg({"players": "sum"}).first()[0] == apps.count() > 2 * lines.count()


@pytest.mark.parametrize("name", ["j13_prior_season", "j19_model_by_side", "f35_f37_blended_rate", "a22_auc", "a16_presence", "m04_start_model"])
def test_lines_without_ratings_are_a_quarter(spark, many, name, monkeypatch):
    """Presence, starts and minutes ask for rests of 10 only, so ten lines of a team are enough where no rating is read."""
    made = []
    monkeypatch.setattr(t, "lines", lambda *a, f=t.lines, **b: made.append(f(*a, **b)) or made[-1])
    registry.QUERIES[name](spark, many)
    assert made and all(rows.groupBy("match_id").count().agg({"count": "max"}).first()[0] <= 2 * 10 for rows in made)


def test_rows_of_players_are_made_without_a_shuffle_of_lines(spark, many):
    """However small the tables that Spark sends to all tasks by itself."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = t.each_group(spark, many, t.lines(spark, many, 10), 10, odd=F.col("player_id") % 2 == 1)
        for df in (t.appearances(spark, many), rows):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin [line" in plan and "SortMergeJoin [line" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_context_rows_differ_by_what_counts(spark, many):
    """Players of a line have rows by their rating of the last season only while it has a weight; each row's rating is that of its players."""
    from touchline.plans import games

    rows = games._context_rows(spark, many)
    late = rows.filter("c_apps >= 4")
    assert late.groupBy("match_id", "line").count().agg({"count": "max"}).first()[0] <= 9
    got = rows.groupBy("match_id", F.round("sr", 6).alias("sr")).agg(F.sum("players").alias("n"))
    apps = t.appearances(spark, many).filter("rating is not null").select("match_id", "player_id")
    want = registry.QUERIES["m02_j11_fit_features"](spark, many).join(apps, ["match_id", "player_id"]).groupBy("match_id", "sr").agg(F.count("sr").alias("n"))
    assert late.count() and got.count() == want.count() and not got.exceptAll(want).count()


def test_match_documents_are_made_within_a_row(spark, many):
    """Nothing is grouped after the matches are there: lists of players come from their team."""
    plan = registry.QUERIES["s34_match_players"](spark, many)._jdf.queryExecution().executedPlan().toString()
    lists = [line for line in plan.split("\n") if "collect_list" in line]
    assert lists and all("match_id" not in line and "is_home" not in line for line in lists)


def test_players_are_made_in_many_tasks(spark):
    """Sides are few bytes, so the tasks of a join are merged; those that make players of them aren't."""
    apps = t.appearances(spark, "/root/testdata/sf0.1")
    assert apps.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_of_equal_scorers_the_first_row_counts(spark, tmp_path):
    """The flag of a repeated line, and with it the goal's side, is that of the row first in the files, however rows arrive."""
    (folder := tmp_path / "lineitem.parquet").mkdir()
    for name, n, flag in (("a", 50, "R"), ("b", 40000, "A")):  # Spark reads the larger file first
        rows = f"select i % 50 as l_orderkey, 1 as l_linenumber, 7 as l_suppkey, 1.0::double as l_quantity, '{flag}' as l_returnflag from range({n}) r(i)"
        duckdb.sql(f"copy ({rows}) to '{folder}/{name}.parquet'")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        goals = registry.QUERIES["s34_match_goals"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [g["side"] for g in goals] == ["h"] * 50


def test_the_match_queue_makes_matches_once(spark):
    plan = registry.QUERIES["z08_match_queue"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("Aggregate [l_orderkey") == 1 and "Union" not in plan


def lines_sent(plan) -> int:
    """Rows of lines, or of their players, that an executed plan wrote to shuffles."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return lines_sent(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return lines_sent(plan.plan())
    names = [plan.output().apply(i).name() for i in range(plan.output().size())] if kind == "ShuffleExchangeExec" else []
    own = plan.metrics().apply("shuffleRecordsWritten").value() if "player_id" in names and "match_id" in names else 0
    children = plan.children()
    return own + sum(lines_sent(children.apply(i)) for i in range(children.size()))


@pytest.mark.parametrize("name", ["w04_w06_squad_history", "w03_season_to_date", "f35_f37_blended_rate", "f38_start_chance", "a22_log_loss_brier", "a20_r_squared"])
def test_lines_of_a_season_stay_in_their_tasks(spark, name):
    """Sides are dealt by team and season before lines are made of them, so windows over a player's season shuffle no line."""
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.01")
    df.collect()
    assert lines_sent(df._jdf.queryExecution().executedPlan()) == 0


def test_one_team_in_a_season_is_as_any(spark):
    """Histories of players who don't move are the same with and without that said."""
    from touchline.operators import windows
    from touchline.plans import games

    rows = t.lines(spark, "/root/testdata/sf0.01", sides=games._numbered(spark, "/root/testdata/sf0.01"), dealt=t.SEASON)
    told = [f(rows, within=w).select("*") for f in (windows.squad_history, windows.season_to_date) for w in ((), ("team",))]
    assert told[0].count() and not told[0].exceptAll(told[1]).count() and not told[2].exceptAll(told[3]).count()


def test_what_a_line_has_is_there_before_its_players(spark):
    """Players are listed for a line and made by a generator, which has the line's columns ready; in a join's loop each player worked them out again."""
    plan = registry.QUERIES["f38_start_chance"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(_ids" in plan


def test_staged_match_pairs_names_not_people(spark):
    """Namesakes of a club meet as one row that counts them, so pairs don't grow with their square; one of several is no match."""
    from touchline.operators import joins

    players = spark.createDataFrame([(i, f"x{i % 2} paz", "como", 1) for i in range(400)] + [(900, "luis roma", None, 1)], "player_id int, name string, club string, block int")
    natives = spark.createDataFrame([(1000 + i, "nico paz", "paz", "nico", "como", 1) for i in range(300)] + [(2000, "luis roma", "roma", "luis", "roma", 1), (2001, "leo roma", "roma", "leo", "roma", 1)], "native_id int, full string, last string, first string, club_name string, block int")
    got = joins.staged_match(players, natives, ["block"])
    assert {tuple(r) for r in got.collect()} == {(900, 2000)}
    alone = joins.staged_match(players, natives.filter("native_id in (1000, 2001)"), ["block"])
    assert {tuple(r) for r in alone.collect()} == {*((i, 1000) for i in range(400)), (900, 2001)}
    assert 0 < shuffled(got._jdf.queryExecution().executedPlan()) < 4 * 701


def test_a_players_rating_is_looked_up(spark):
    """Nothing is rounded once players are made: what they add to a line's features is one of few ratings."""
    plan = registry.QUERIES["m02_j11_fit_features"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    made = plan.index("Generate explode(_ids")
    assert "round(" in plan[made:] and "round(" not in plan[:made]


def test_matches_alike_share_a_document(spark, tmp_path, monkeypatch):
    """Of two teams' matches whose ids leave equal rests, one has a document, so documents don't grow with the matches."""
    from touchline.plans import records

    docs = []
    monkeypatch.setattr(records.feeds, "match_players", lambda df, f=records.feeds.match_players: docs.append(df) or f(df))
    for copies in (1, 3):
        (folder := tmp_path / str(copies)).mkdir()
        for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
            duckdb.sql(f"copy (select * replace ({key} + i * 360000 as {key}) from '{SF}/{name}.parquet', range({copies}) r(i)) to '{folder}/{name}.parquet'")
        db = duckdb.connect()
        for name in ("orders", "lineitem", "customer", "supplier", "nation"):
            if not (folder / f"{name}.parquet").exists():
                os.symlink(f"{SF}/{name}.parquet", folder / f"{name}.parquet")
            db.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
        df, said = registry.QUERIES["s34_match_players"](spark, str(folder)), db.sql(registry.ORACLES["s34_match_players"])
        assert verify.rows_of(df.columns, [tuple(r) for r in df.collect()]) == verify.rows_of(said.columns, said.fetchall())
    assert docs[0].count() == docs[1].count() > 0
