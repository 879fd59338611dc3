"""Queries that read feeds: documents are made from driver tables and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.plans.registry import query
from touchline.sources import feeds
from touchline.sources import tables as t


@query("""select league, match_id, cast(season as varchar) as round, h as home_id, a as away_id, cast(hs as int) as home_score, cast(as_ as int) as away_score, match_id % 3 > 0 as finished from v_match where h > 0 and a > 0""")
def s02_s03_league_matches(spark, sf):
    team = lambda c, s: F.struct(F.col(c).cast("string").alias("id"), F.lit("n").alias("name"), F.col(s).cast("int").alias("score"))
    text = F.when(F.col("match_id") % 2 == 0, F.concat_ws(" - ", F.col("hs").cast("string"), F.col("as_").cast("string")))
    status = F.struct(F.date_format("dt", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utcTime"), F.when(F.col("match_id") % 3 > 0, True).alias("finished"), text.alias("scoreStr"))
    m = F.struct(F.col("match_id").cast("string").alias("id"), F.when(F.col("match_id") % 5 > 0, F.col("season").cast("string")).alias("round"), F.col("season").cast("string").alias("roundName"), team("h", "hs").alias("home"), team("a", "as_").alias("away"), status.alias("status"))
    # one document for each day of a league: documents stay small
    docs = t.matches(spark, sf).groupBy("league", "dt").agg(F.to_json(F.struct(F.struct(F.collect_list(m).alias("allMatches")).alias("matches"))).alias("doc"))
    return feeds.league_matches(docs).select("league", "match_id", "round", "home_id", "away_id", "home_score", "away_score", "finished")


@query("""with s as (select c_custkey as player_id, c_acctbal as v, c_nationkey from customer) select player_id, round(case when player_id % 2 = 0 then v end, 6) as goals, round(case when player_id % 3 = 0 then v + 1 end, 6) as saves from s where player_id % 2 = 0 or player_id % 3 = 0""")
def s11_s12_season_stats(spark, sf):
    c = t.read(spark, sf, "customer", F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey")
    row = F.struct(F.col("id").alias("ParticiantId"), F.when(F.col("name") == "goals", F.col("c_acctbal")).alias("StatValue"), (F.col("c_acctbal") + 1).alias("SubStatValue"))
    lists = c.withColumn("name", F.explode(F.filter(F.array(F.when(F.col("id") % 2 == 0, "goals"), F.when(F.col("id") % 3 == 0, "saves")), lambda x: x.isNotNull())))
    docs = lists.groupBy("name", "c_nationkey").agg(F.to_json(F.struct(F.array(F.struct(F.col("name").alias("StatName"), F.collect_list(row).alias("StatList"))).alias("TopLists"))).alias("doc"))
    parsed = feeds.stat_list(docs.select(F.col("name").alias("list_name"), (F.col("name") == "saves").alias("use_sub"), "doc"))
    return feeds.season_stats(parsed).select("player_id", F.round("goals", 6).alias("goals"), F.round("saves", 6).alias("saves"))


@query("select ord as match_id, player_id, card, cast(ord % 90 as int) as minute from v_card")
def s14_card_events(spark, sf):
    e = F.struct(F.lit("Card").alias("type"), F.col("card").alias("card"), (F.col("ord") % 90).cast("int").alias("time"), F.when(F.col("ord") % 2 == 0, F.col("player_id")).alias("playerId"), F.struct(F.col("player_id").alias("id")).alias("player"))
    other = F.struct(F.lit("Goal").alias("type"), F.lit(None).cast("string").alias("card"), F.lit(1).alias("time"), F.lit(1).cast("long").alias("playerId"), F.struct(F.lit(1).cast("long").alias("id")).alias("player"))
    docs = t.cards(spark, sf).select(F.col("ord").alias("match_id"), F.to_json(F.struct(F.array(e, other).alias("events"))).alias("doc"))
    return feeds.card_events(docs).select("match_id", "player_id", "card", "minute")


@query("select o_orderkey as match_id, cast(1.5 + (o_orderkey % 7) / 4.0 as double) as home, cast(case when o_orderkey % 5 > 0 then 3.25 end as double) as draw, cast(2.0 + (o_orderkey % 3) as double) as away from orders where o_orderkey % 10 <> 0")
def s15_match_odds(spark, sf):
    k = F.col("o_orderkey")
    price = lambda name, v: F.struct(F.lit(name).alias("name"), v.cast("string").alias("oddsDecimal"))
    known = F.array(price("1", F.lit(1.5) + (k % 7) / 4.0), price("X", F.when(k % 5 > 0, "3.25").otherwise("n/a")), price("2", F.lit(2) + k % 3))
    none = F.array(price("1", F.lit("-")), price("x", F.lit("")), price("2", F.lit("?")))
    docs = t.read(spark, sf, "orders", "o_orderkey").select(k.alias("match_id"), F.to_json(F.struct(F.array(F.struct(F.when(k % 10 == 0, none).otherwise(known).alias("selections"))).alias("markets"))).alias("doc"))
    return feeds.match_odds(docs)


@query("select event_id, 'k' as name, cast(json_extract_string(props, '$.k') as double) as value from events where json_extract_string(props, '$.k') is not null")
def s35_flat_numbers(spark, sf):
    return feeds.flat_numbers(t.read(spark, sf, "events", "event_id", F.col("props").alias("doc")), "event_id")


@query("""select l_orderkey as match_id, l_linenumber as ord, case when hs > ph then 'h' when a > pa then 'a' end as side from (
 select *, coalesce(lag(hs) over w, 0) as ph, coalesce(lag(a) over w, 0) as pa from (
  select l_orderkey, l_linenumber, cast(sum(case when r = 'R' then 1 else 0 end) over w as bigint) as hs, cast(sum(case when r = 'A' then 1 else 0 end) over w as bigint) as a from (select l_orderkey, l_linenumber, max(l_returnflag) as r from lineitem group by 1, 2)
  window w as (partition by l_orderkey order by l_linenumber)) window w as (partition by l_orderkey order by l_linenumber))""")
def w10_scoring_side(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("match_id").orderBy("ord")
    lines = t.read(spark, sf, "lineitem", F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("ord"), "l_returnflag").groupBy("match_id", "ord").agg(F.max("l_returnflag").alias("r"))
    scores = lines.select("match_id", "ord", F.sum(F.when(F.col("r") == "R", 1).otherwise(0)).over(w).alias("home_score"), F.sum(F.when(F.col("r") == "A", 1).otherwise(0)).over(w).alias("away_score"))
    return feeds.scoring_side(scores).select("match_id", "ord", "side")


@query("""select l_orderkey as match_id, cast(sum(case when l_returnflag = 'R' and l_linestatus = 'F' then 1 else 0 end) as bigint) as own_goals, cast(sum(case when l_returnflag <> 'R' and l_linestatus = 'F' then 1 else 0 end) as bigint) as pens from lineitem group by 1""")
def a01_penalties_own_goals(spark, sf):
    own = F.col("l_returnflag") == "R"
    f = F.col("l_linestatus") == "F"
    return t.read(spark, sf, "lineitem", F.col("l_orderkey").alias("match_id"), "l_returnflag", "l_linestatus").groupBy("match_id").agg(F.count_if(own & f).alias("own_goals"), F.count_if(~own & f).alias("pens"))


@query("""with c as (select c_nationkey, c_mktsegment, count(*) as n, min(c_custkey) as first from customer group by 1, 2), r as (select *, row_number() over (partition by c_nationkey order by n desc, first) as k from c),
m as (select c_nationkey, min(c_mktsegment) filter (where n = mx) as modal from (select *, max(n) over (partition by c_nationkey) as mx from c) group by 1)
select r.c_nationkey, r.c_mktsegment as most_common, modal from r join m using (c_nationkey) where k = 1""")
def a03_a04_modal(spark, sf):
    rows = t.read(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    counts = rows.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))
    first = F.max(F.struct("n", (-F.col("first")).alias("o"), "c_mktsegment"))["c_mktsegment"]
    modal = F.min(F.struct((-F.col("n")).alias("o"), "c_mktsegment"))["c_mktsegment"]
    return counts.groupBy("c_nationkey").agg(first.alias("most_common"), modal.alias("modal"))


@query(r"""with l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as target, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as label, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 0)))) as pos from pages)
select page_id, cast(min(pos) as int) as pos, target, arg_min(label, pos) as label from l group by page_id, target""")
def s23_f15_page_links(spark, sf):
    """(page_id, pos, target, label) of links in raw pages, the first of each target."""
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">[^<]*</a>'), F.lit(0))
    rows = t.read(spark, sf, "pages", "page_id", "html").select("page_id", F.posexplode(links).alias("pos", "a"))
    rows = rows.select("page_id", "pos", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("target"), F.regexp_extract("a", r">([^<]*)<", 1).alias("label"))
    return rows.groupBy("page_id", "target").agg(F.min(F.struct("pos", "label")).alias("f")).select("page_id", "f.pos", "target", "f.label")
