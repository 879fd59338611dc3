"""Landed documents: versions and leases, the refresh job, the data source, the scan of match files, rows from pages."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from touchline.operators import refresh
from touchline.sources import datasource, roster
from touchline.sources.landed import COMPACT, Conflict, Store
from touchline.streaming import landing as scan

H = 3_600_000
ASK = "collection string, key string, forced boolean, who string"


def docs(spark, rows):
    return spark.createDataFrame(rows, "collection string, key string, data string, cached_at long")


def held(store):
    return {(r.collection, r.key): (r.data, r.cached_at) for r in store.read().collect()}


def answers(df):
    return sorted((r.collection, r.key, r.who, r.action, r.outcome, r.data) for r in df.collect())


def no_fetch(keys):
    return keys.limit(0).withColumn("data", F.lit(""))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_versions_show_the_newest_document_and_compact(spark, store):
    assert store.manifest()["version"] == 0 and held(store) == {}
    for i in range(COMPACT + 3):
        store.land(docs(spark, [("odds", "1", f"[{i}]", i), ("odds", str(100 + i), "[]", i)]))
    assert len(held(store)) == COMPACT + 4
    assert held(store)["odds", "1"] == (f"[{COMPACT + 2}]", COMPACT + 2)
    assert len(store.manifest()["parts"]) <= COMPACT


def test_a_version_is_taken_once(spark, store):
    was = store.manifest()
    store.land(docs(spark, [("odds", "1", "[1]", 1)]))
    with pytest.raises(Conflict):
        store._put(was, ["elsewhere"], [])
    assert held(store) == {("odds", "1"): ("[1]", 1)}


def test_a_job_that_lost_the_race_takes_the_next_version(spark, store, monkeypatch):
    real, lost = store.manifest, []

    def late():
        was = real()
        if not lost:
            lost.append(1)
            store.land(docs(spark, [("odds", "2", "[2]", 1)]))
        return was

    monkeypatch.setattr(store, "manifest", late)
    store.land(docs(spark, [("odds", "1", "[1]", 1)]))
    assert set(held(store)) == {("odds", "1"), ("odds", "2")}


def test_refresh_answers_and_lands(spark, store):
    now = 100 * H
    store.land(docs(spark, [("odds", "young", "[1]", now - 1000), ("odds", "stale", "[2]", now - H), ("odds", "gone", "[3]", now - 9 * H), ("odds", "empty", "[]", now - 1000), ("odds", "fails", "[5]", now - 9 * H), ("odds", "forced", "[6]", now - 60_000), ("odds", "soon", "[7]", now - 20_000), ("odds", "other", "[8]", now - H)]))
    store.lease(docs(spark, [("odds", "other", "", 0)]), now, H)
    asks = [("odds", k, k in ("forced", "soon"), "a") for k in ("young", "stale", "gone", "empty", "fails", "forced", "soon", "other", "never", "nowhere")]
    asks += [("odds", "gone", None, "b"), ("unknown", "x", False, "a")]

    def fetch(keys):
        assert keys.filter("key in ('young', 'soon', 'other')").isEmpty()
        assert keys.count() == keys.distinct().count()
        return keys.filter("key <> 'nowhere'").withColumn("data", F.when(F.col("key") == "fails", "[]").otherwise(F.concat(F.lit('["'), "key", F.lit('"]'))))

    got = answers(refresh.refresh(store, spark.createDataFrame(asks, ASK), fetch, now))
    assert got == sorted(
        [
            ("odds", "young", "a", "serve", "kept", "[1]"), ("odds", "stale", "a", "refresh", "stale", "[2]"), ("odds", "gone", "a", "fetch", "fetched", '["gone"]'), ("odds", "gone", "b", "fetch", "fetched", '["gone"]'),
            ("odds", "empty", "a", "fetch", "fetched", '["empty"]'), ("odds", "fails", "a", "fetch", "old", "[5]"), ("odds", "forced", "a", "fetch", "fetched", '["forced"]'), ("odds", "soon", "a", "serve", "kept", "[7]"),
            ("odds", "other", "a", "refresh", "stale", "[8]"), ("odds", "never", "a", "fetch", "fetched", '["never"]'), ("odds", "nowhere", "a", "fetch", "error", None), ("unknown", "x", "a", "fetch", "fetched", '["x"]'),
        ]
    )
    after = held(store)
    assert after["odds", "stale"] == ('["stale"]', now) and after["odds", "fails"] == ("[5]", now - 9 * H) and after["odds", "other"] == ("[8]", now - H)
    assert ("odds", "nowhere") not in after
    assert [r.key for r in store.leased(now).collect()] == ["other"]


def test_a_job_that_fails_leaves_the_old_version_and_no_lease(spark, store):
    store.land(docs(spark, [("odds", "1", "[1]", 0)]))

    def broken(keys):
        raise OSError("no network")

    with pytest.raises(OSError, match="no network"):
        refresh.refresh(store, spark.createDataFrame([("odds", "1", False, "a")], ASK), broken, 10 * H)
    assert held(store) == {("odds", "1"): ("[1]", 0)}
    assert store.leased(10 * H).isEmpty()


def test_a_lease_that_ran_out_binds_nobody(spark, store):
    key = docs(spark, [("odds", "1", "", 0)])
    store.lease(key, 0, 1000)
    assert store.lease(key, 500, 1000)[1].isEmpty()
    assert not store.lease(key, 1000, 1000)[1].isEmpty()


def test_empty_batches(spark, store):
    assert refresh.refresh(store, spark.createDataFrame([], ASK), no_fetch, 5).collect() == []


# --- data source


@pytest.fixture
def landed(tmp_path):
    for name, files in {"match_xg": 3, "match_odds": 2, "_hidden": 1}.items():
        folder = tmp_path / "landed" / name
        folder.mkdir(parents=True)
        for i in range(files):
            (folder / f"part-{i}.jsonl").write_text("".join(json.dumps({"key": str(10 * i + j), "cached_at": j, "doc": {"n": j, "é": None}}) + "\n" for j in range(4)))
    single = tmp_path / "landed" / "seasons"
    single.mkdir()
    (single / "47.json").write_text('{"allAvailableSeasons": ["b", "a"], "details": {"selectedSeason": "b"}}')
    (single / "55.json").write_text('{"allAvailableSeasons": ["x"], "details": {"selectedSeason": "x"}}')
    (tmp_path / "landed" / "match_odds" / "part-0.jsonl").write_text('{"key": 1, "doc": {}}\nnot json\n\n[1]\n{"key": "2"}')
    return str(tmp_path / "landed")


def test_landed_documents_come_in_partitions(spark, landed):
    rows = datasource.landed(spark, landed, partition_bytes="1")
    assert rows.rdd.getNumPartitions() == 3 + 2 + 2
    assert datasource.landed(spark, landed).rdd.getNumPartitions() == 1
    assert rows.groupBy("collection").count().collect() and {r.collection for r in rows.collect()} == {"match_xg", "match_odds", "seasons"}
    assert {r.doc for r in rows.filter("collection = 'match_odds' and key is null").collect()} == {"not json", "[1]", '{"key": "2"}'}
    assert datasource.landed(spark, landed, collections="match_xg,seasons").count() == 14


def test_filters_reach_the_source(spark, landed):
    rows = datasource.landed(spark, landed, partition_bytes="1")
    assert rows.filter("collection = 'match_xg'").rdd.getNumPartitions() == 3
    assert rows.filter("collection in ('seasons', 'none') and key = '55'").rdd.getNumPartitions() == 1
    one = rows.filter("collection = 'match_xg' and key in ('1', '12', 'x') and cached_at > 1")
    assert [(r.key, r.cached_at) for r in one.collect()] == [("12", 2)]
    assert rows.filter("collection = 'nothing'").collect() == []


def test_feeds_are_read_by_name(spark, landed, tmp_path):
    assert sorted(tuple(r) for r in datasource.feed(spark, landed, "seasons").collect()) == [(47, "b", "a"), (55, "x", None)]
    stats = {"TopLists": [{"StatName": "saves", "StatList": [{"ParticiantId": 7, "StatValue": 1.5, "SubStatValue": 30.0}]}]}
    (tmp_path / "landed" / "stat_list").mkdir()
    (tmp_path / "landed" / "stat_list" / "x.jsonl").write_text("".join(json.dumps({"key": "saves/true", "cached_at": at, "doc": doc}) + "\n" for at, doc in ((2, stats), (1, {}), (None, {}))))
    assert [tuple(r) for r in datasource.feed(spark, landed, "stat_list").collect()] == [("saves", 7, 30.0)]  # the newest document, its key in parts
    with pytest.raises(ValueError, match="no feed"):
        datasource.feed(spark, landed, "weather")
    with pytest.raises(Exception, match="path"):
        spark.read.format("landed").load().collect()


# --- scan of match files


def test_scans_take_each_file_once(spark, tmp_path):
    folder, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    match = lambda i, **k: json.dumps({"id": i, "date": "2024-05-01T10:00:00Z", "league": 1, "season": "24", "round": "3", "h": {"id": 1, "score": 2}, "a": {"id": 2, "score": 0}, "more": [1]} | k)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([match(1), match(2, date=None), match(3, h={"id": 1, "score": None}), match(4, date="yesterday"), '{"id": 5, "h":', match(6, a=None), "[]"]))
    scan.scan_matches(spark, folder, table, check).awaitTermination()
    first = sorted((r.match_id or 0, r.status) for r in spark.read.parquet(table).collect())
    assert first == sorted([(1, "good"), (2, "skipped"), (3, "skipped"), (4, "skipped"), (0, "corrupt"), (6, "skipped"), *[(0, "corrupt")] * (len(first) - 6)])
    scan.scan_matches(spark, folder, table, check).awaitTermination()
    assert spark.read.parquet(table).count() == len(first)
    (tmp_path / "in" / "b.json").write_text(match(7))
    scan.scan_matches(spark, folder, table, check).awaitTermination()
    got = scan.scanned(spark, table).collect()
    assert sorted((r.match_id, r.file, r.hs, r.as_) for r in got) == [(1, "a.json", 2, 0), (7, "b.json", 2, 0)]
    assert all(r.landed_at is not None for r in got)


# --- rows from pages


def player(i, last, first="", places=(), href=None):
    spans = "".join(f'<span class="player-position">{p}</span>' for p in places)
    return f'<a href="{href or f"/players/{i}"}"><b class="team-player-last-name">{last}</b><i class="team-player-first-name">{first}</i><img src="x"><div class="team-player-position">{spans}</div></a>'


def test_roster_rows(spark):
    odd = '<a href="/other">x</a><span class="player-position">no</span><a href=/players/9 ><b class="team-player-last-name">Open'
    pages = [
        (1, '<p class="league-season">Season\n26-27 &bull; <b>Pro</b></p><p class="league-season">Season 20-21</p>' + player(3, " Äs &amp; Co ", "Bo", ("M", "C")) + player(4, "", "None") + player(3, "Again") + player(5, "x", href="/players/5/edit") + odd),
        (2, '<div class="league-season">Season 25-26</div>' + player(7, "Old")), (3, player(8, "No season")), (4, None), (5, ""), (6, "<a <a <a"),
    ]
    df = spark.createDataFrame(pages, "team int, html string")
    got = sorted((r.team, r.player_id, r.last_name, r.first_name, tuple(r.positions), r.is_current) for r in roster.rosters(df, 2026).collect())
    assert got == [(1, 3, "Äs & Co", "Bo", ("M", "C"), True), (1, 9, "Open", "", (), True), (2, 7, "Old", "", (), False), (3, 8, "No season", "", (), False)]
    assert {r.is_current for r in roster.rosters(df, None).collect()} == {False}


def test_link_rows(spark):
    df = spark.createDataFrame([(1, 'a<a href="/x"> One <b>two</b></a><a href="/y">Y<a href="/x">again</a><a>none</a><a href="http://z">z</a>'), (2, None)], "page_id int, html string")
    got = sorted(tuple(r) for r in roster.links(df, "/").collect())
    assert got == [(1, 0, "/x", "One two"), (1, 1, "/y", "Y")]
