"""Queries on landed files: the refresh job, the scan of match files, the data source, rows from pages."""

from __future__ import annotations

import posixpath

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline import dims
from touchline.operators import ratings, refresh
from touchline.plans.games import _RATED, _rated, _walk_sql
from touchline.plans.registry import query
from touchline.sources import datasource, dimensions, landing, roster
from touchline.sources import tables as t
from touchline.sources.landed import Store

NOW = 1_700_000_000_000
_TIERS = " union all ".join(f"select '{k}' as collection, {i} as no, {f} as fresh_ms, {s} as stale_ms" for i, (k, (f, s)) in enumerate(dims.TIERS.items()))


@query(f"""with tiers as ({_TIERS}), c as (select c_custkey as k, c_custkey * 7919000 % 100000000 as age, c_custkey % 6 <> 5 as landed from customer),
r as (select *, landed and k % 9 <> 0 as has, case when k % 9 = 0 then '[]' else '["old ' || k || '"]' end as old from (select *, 1 as ask, k % 4 = 0 as forced from c union all select *, 2, false from c where k % 13 = 0) join tiers on no = k % 10),
a as (select *, case when not has then 'fetch' when forced and age >= 30000 then 'fetch' when age < fresh_ms then 'serve' when age < stale_ms then 'refresh' else 'fetch' end as action from r),
b as (select *, max(case when action <> 'serve' then 1 else 0 end) over (partition by k) = 1 and k % 11 <> 0 and k % 7 > 2 as new from a)
select k as key, ask, collection, action, case when action = 'serve' then 'kept' when action = 'refresh' then 'stale' when new then 'fetched' when has then 'old' else 'error' end as outcome,
 case when action in ('serve', 'refresh') then old when new then '["new ' || k || '"]' when has then old end as data, case when new then '["new ' || k || '"]' when landed then old end as stored from b""")
def s25_refresh_job(spark, sf):
    """One batch of requests: a sixth of the keys never landed, a ninth landed empty, an eleventh is leased by another job, and three sevenths can't be fetched."""
    store = Store(spark, landing.new_folder(spark, "landed"))
    k = F.col("k")
    names = F.element_at(F.array(*map(F.lit, dims.TIERS)), (k % 10 + 1).cast("int"))
    customers = t.read(spark, sf, "customer", F.col("c_custkey").alias("k")).withColumn("collection", names).withColumn("key", k.cast("string"))
    old = F.when(k % 9 == 0, "[]").otherwise(F.concat(F.lit('["old '), "key", F.lit('"]')))
    store.land(customers.filter(k % 6 != 5).select("collection", "key", old.alias("data"), (F.lit(NOW) - k * 7919000 % 100000000).alias("cached_at")))
    store.lease(customers.filter(k % 11 == 0), NOW, 1000)
    asks = customers.withColumns({"ask": F.lit(1), "forced": k % 4 == 0}).unionByName(customers.filter(k % 13 == 0).withColumns({"ask": F.lit(2), "forced": F.lit(False)}))

    def fetch(keys):
        n = F.col("key").cast("long") % 7
        return keys.filter(n > 0).withColumn("data", F.when(n == 1, "[]").when(n > 2, F.concat(F.lit('["new '), "key", F.lit('"]'))))

    answered = refresh.refresh(store, asks, fetch, NOW)
    after = store.read().select("collection", "key", F.col("data").alias("stored"))
    return answered.join(after, ["collection", "key"], "left").select(k.alias("key"), "ask", "collection", "action", "outcome", "data", "stored")


@query("""select case when match_id % 10 <> 3 then match_id end as match_id, case when match_id % 10 = 3 then 'corrupt' when match_id % 10 < 3 then 'skipped' else 'good' end as status,
 case when match_id % 10 not in (0, 3) then hs end as hs, case when match_id % 10 <> 3 then as_ end as as_, case when match_id % 10 = 3 then '{"id":' || match_id || ',"h":{' end as line, match_id % 2 as landing from v_match""")
def s37_landed_scan(spark, sf):
    """Match files that land in two goes, each taken once; a tenth of the lines is broken, three tenths miss a score or a date."""
    from touchline.streaming import landing as scan

    folder, table, checkpoint = (landing.new_folder(spark, x) for x in ("landed", "scanned", "check"))
    k = F.col("match_id")
    date = F.when(k % 10 == 1, F.lit(None)).when(k % 10 == 2, "soon").otherwise(F.date_format("dt", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    side = lambda team, score: F.struct(F.col(team).alias("id"), F.lit("n").alias("name"), score.cast("int").alias("score"))
    doc = F.to_json(F.struct(k.alias("id"), date.alias("date"), "league", F.col("season").cast("string").alias("season"), side("h", F.when(k % 10 != 0, F.col("hs"))).alias("h"), side("a", F.col("as_")).alias("a")))
    lines = t.matches(spark, sf).select(k, F.when(k % 10 == 3, F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"h":{'))).otherwise(doc).alias("value"))
    for part in range(2):
        lines.filter(k % 2 == part).select("value").write.mode("append").text(folder)
        scan.scan_matches(spark, folder, table, checkpoint).awaitTermination()
    rows = spark.read.parquet(table).withColumn("line", F.trim("corrupt"))
    told = F.coalesce("match_id", F.regexp_extract("line", r"\d+", 0).cast("long"))
    return rows.select("match_id", "status", F.col("hs").cast("long").alias("hs"), F.col("as_").cast("long").alias("as_"), "line", (told % 2).alias("landing"))


def _land(docs, folder: str, collection: str, key: str) -> None:
    """Documents (key column, doc) as lines of the landed source."""
    line = F.concat(F.lit('{"key":"'), F.col(key).cast("string"), F.lit('","cached_at":'), F.lit(str(NOW)), F.lit(',"doc":'), "doc", F.lit("}"))
    docs.select(line.alias("value")).write.mode("append").text(posixpath.join(folder, collection))


@query(f"{_walk_sql('league', goals=('hx', 'ax'), views='(select m.*, case when match_id % 4 > 0 then match_id % 5 / 4.0::double else hs end as hx, case when match_id % 4 > 0 then match_id % 3 / 2.0::double else as_ end as ax from v_match m)')} {_RATED}")
def w15_w16_s17_strength_from_xg(spark, sf):
    """Strength before each match from expected goals, read from landed documents by the data source; goals stand in where there are none."""
    k = F.col("match_id")
    folder = landing.new_folder(spark, "landed")
    m = t.matches(spark, sf)
    row = F.struct(F.lit("expected_goals").alias("key"), F.array((k % 5 / 4.0).cast("string"), (k % 3 / 2.0).cast("string")).alias("stats"))
    groups = F.array(F.struct(F.when(k % 4 > 0, F.array(row)).alias("stats")))
    doc = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(groups.alias("stats")).alias("All")).alias("Periods")).alias("stats")).alias("content")))
    _land(m.select(k, doc.alias("doc")), folder, "match_xg", "match_id")
    return _rated(ratings.replay(m.join(datasource.feed(spark, folder, "match_xg"), "match_id", "left")))


@query(r"""with l as (select page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 1)) as target, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 2)) as label, unnest(range(len(regexp_extract_all(html, '<a href="(/[^"]*)">', 0)))) as pos from pages)
select page_id, target, cast(min(pos) as int) as pos, trim(arg_min(label, pos)) as label from l group by 1, 2""")
def s23_page_targets(spark, sf):
    """The first link of each target of each raw page, by a table function in a lateral join."""
    return roster.links(t.read(spark, sf, "pages", "page_id", "html"), "/")


@query("""select c_nationkey as team, c_custkey as player_id, 'L' || c_custkey as last_name, case when c_custkey % 4 > 0 then c_name else '' end as first_name,
 case when c_custkey % 3 = 0 then 'Por' when c_custkey % 3 = 1 then 'M,C' else '' end as positions, c_nationkey % 3 = 1 as is_current from customer where c_custkey % 10 <> 7 and c_custkey % 10 <> 8""")
def s23_roster_rows(spark, sf):
    """Roster pages of each team, a page for each 50 players: each row is rendered twice, a tenth has no last name, another tenth links elsewhere."""
    k = F.col("c_custkey")
    place = lambda p: F.concat(F.lit('<span class="player-position x">'), F.lit(p), F.lit(" </span>"))
    places = F.when(k % 3 == 0, place("Por")).when(k % 3 == 1, F.concat(place("M"), F.lit("<br>"), place("C"))).otherwise("")
    last = F.when(k % 10 == 7, "").otherwise(F.concat(F.lit("L"), k.cast("string")))
    href = F.concat(F.lit("/players/"), k.cast("string"), F.when(k % 10 == 8, "/edit").otherwise(""))
    text = lambda css, c: F.concat(F.lit(f'<div class="{css}"> '), c, F.lit("\n</div>"))
    row = F.concat(
        F.lit('<a class="row" href="'), href, F.lit('">'), text("team-player-last-name", last), text("team-player-first-name", F.when(k % 4 > 0, F.col("c_name")).otherwise("")),
        F.lit('<div class="team-player-position">'), places, F.lit("</div></a>"),
    )
    season = F.when(F.col("c_nationkey") % 3 == 0, "Season 24-25").when(F.col("c_nationkey") % 3 == 1, "Season <b>26-27</b> &bull; Pro").otherwise("no season")
    body = F.array_join(F.array_sort(F.collect_list("row")), "")
    pages = t.read(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey").withColumn("row", row).groupBy(F.col("c_nationkey").alias("team"), F.floor(k / 50).alias("page"), season.alias("season")).agg(body.alias("body"))
    pages = pages.select("team", F.concat(F.lit('<html><div class="league-season">'), "season", F.lit("</div><main>"), "body", F.lit('</main><div class="mobile">'), "body", F.lit("</div></html>")).alias("html"))
    return roster.rosters(pages, 2026).select("team", "player_id", "last_name", "first_name", F.array_join("positions", ",").alias("positions"), "is_current")


_LEAGUES = " union all ".join(f"select {i} as no, {k} as league_id, '{name}' as name, '{code}' as country_code, {tournament} as tournament_id" for i, (k, (name, _, code, tournament)) in enumerate(sorted(dims.LEAGUES.items())))
_POSITIONS = " union all ".join(f"select '{p}' as position, '{g}' as grp, {dims.GROUP_ORDER[g]} as place" for p, g in dims.POSITION_GROUP.items())


@query(f"""with d as ({_LEAGUES}) select league_id, name, country_code, tournament_id, count(*) as matches from v_match join d on no = league group by 1, 2, 3, 4""")
def s41_leagues(spark, sf):
    """Matches by league, with the leagues dimension (a region stands for a league, in order of id)."""
    known = dimensions.leagues(spark).withColumn("no", F.row_number().over(Window.orderBy("league_id")) - 1)
    rows = t.matches(spark, sf).groupBy("league").agg(F.count(F.lit(1)).alias("matches"))
    return rows.join(F.broadcast(known), F.col("no") == F.col("league")).select("league_id", "name", "country_code", "tournament_id", "matches")


@query(f"""with d as ({_POSITIONS}) select squad_id, pos, grp, place, count(*) as players from v_squad join d on position = pos group by 1, 2, 3, 4""")
def s41_positions(spark, sf):
    """Players by squad and position, with the positions dimension."""
    rows = t.squads(spark, sf).groupBy("squad_id", "pos").agg(F.count(F.lit(1)).alias("players"))
    return rows.join(F.broadcast(dimensions.positions(spark)), F.col("position") == F.col("pos")).select("squad_id", "pos", "grp", "place", "players")
