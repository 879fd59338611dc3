"""Queries on squads: line-ups, scores, summaries, orders, validation, simulation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline import dims
from touchline.functions import rules
from touchline.operators import joins, lineup, regret
from touchline.plans.registry import query
from touchline.sources import tables as t

_GROUP = "case when pos = 'GK' then 'GK' when pos in ('RB', 'CB', 'LB', 'WB') then 'DEF' when pos in ('DM', 'CM', 'W', 'AM') then 'MID' else 'FWD' end"
_MALUS = " union all ".join(f"select '{s}' as slot_pos, '{p}' as pos, cast({m} as double) as malus" for s, row in dims.MALUS.items() for p, m in row.items())
_SLOTS = " union all ".join(f"select '{f}' as formation, {i} as slot_no, '{p}' as slot_pos" for f, ss in dims.SLOTS.items() for i, s in enumerate(ss) for p in s)


def _squads(spark, sf):
    return t.squads(spark, sf).withColumn("positions", F.array("pos"))


@query()
def m09_m11_best_lineups(spark, sf):
    return lineup.best_lineups(lineup.formation_lineups(_squads(spark, sf)))


@query()
def m15_formation_regret(spark, sf):
    """The best line-up of each formation against the squad's best."""
    rows = lineup.formation_lineups(_squads(spark, sf))
    return rows.select("squad_id", "formation", "score", (F.max("score").over(Window.partitionBy("squad_id")) - F.col("score")).alias("regret"))


def _results(spark, sf):
    """What squad players brought: three in ten didn't play."""
    k = F.col("player_id")
    return t.squads(spark, sf).select("squad_id", "player_id", (k * 11 % 10 < 7).alias("played"), (F.lit(4.0) + k * 67 % 60 / 10.0).alias("points"), (F.lit(5.5) + k * 41 % 30 / 10.0).alias("base"))


@query()
def m15_line_up_regret(spark, sf):
    """What the engine's and hindsight's line-ups of each formation brought."""
    return regret.formation_regret(_squads(spark, sf), _results(spark, sf)).drop("formation_no")


@query()
def a26_m15_decomposition(spark, sf):
    """Of each squad: the engine's line-up, the best formation, the best players, both, and the mean formation."""
    return regret.decompose(regret.formation_regret(_squads(spark, sf), _results(spark, sf)))


@query()
def a26_m15_regret_by_region(spark, sf):
    """Means of the decomposition by region."""
    rows = regret.decompose(regret.formation_regret(_squads(spark, sf), _results(spark, sf)))
    return regret.regret_means(rows.withColumn("region", F.col("squad_id") % 5), ["region"])


@query()
def m15_search_bounds(spark, sf):
    """The hill climb's score of each squad and formation, and one that no line-up exceeds."""
    return regret.bounds(_squads(spark, sf))


@query(f"""with m as ({_MALUS}), s as ({_SLOTS}) select squad_id, formation, slot_no, player_id, max(malus) as malus from v_squad join m using (pos) join s using (slot_pos) group by 1, 2, 3, 4""")
def j22_a13_slot_fits(spark, sf):
    return lineup.slot_fits(_squads(spark, sf))


@query("""select squad_id, player_id, total, case when k % 3 = 0 then total else greatest(0.0, total - 1.5 * 15 * start_prob) end as effective from v_squad""")
def f41_effective_score(spark, sf):
    malus = F.when(F.col("k") % 3 == 0, 0.0).otherwise(-1.5)
    return t.squads(spark, sf).select("squad_id", "player_id", "total", rules.effective(F.col("total"), malus, F.col("start_prob")).alias("effective"))


@query("""with b as (select squad_id, avg(base_rating) as mean from v_squad where pos in ('RB', 'CB', 'LB') group by 1)
select squad_id, round(mean, 9) as mean, cast(case when mean < 7 then 0 else least(5, floor((mean - 7) / 0.25 + 1e-9) + 1) end as bigint) as bonus from b""")
def a14_f42_defence_bonus(spark, sf):
    b = t.squads(spark, sf).filter("pos in ('RB', 'CB', 'LB')").groupBy("squad_id").agg(F.avg("base_rating").alias("mean"))
    return b.select("squad_id", F.round("mean", 9).alias("mean"), rules.defence_bonus(F.col("mean")).alias("bonus"))


@query(f"""with g as (select *, {_GROUP} as grp from v_squad) select squad_id, round(avg(base_rating), 9) as mean_rating, count(*) filter (where grp = 'GK') as keepers, round(sum(total) filter (where grp = 'GK'), 6) as keeper_total,
 round(sum(total) filter (where grp in ('MID', 'FWD')), 6) as front_total, arg_max(player_id, base_rating * 1000 - k) as best from g group by 1""")
def a09_a17_squad_summary(spark, sf):
    g = t.squads(spark, sf).withColumn("grp", rules.lookup(F.col("pos"), dims.POSITION_GROUP))
    best = F.max(F.struct("base_rating", (-F.col("k")).alias("ord"), "player_id"))["player_id"]
    keeper = F.col("grp") == "GK"
    return g.groupBy("squad_id").agg(
        F.round(F.avg("base_rating"), 9).alias("mean_rating"), F.count_if(keeper).alias("keepers"), F.round(F.sum(F.when(keeper, F.col("total"))), 6).alias("keeper_total"),
        F.round(F.sum(F.when(F.col("grp").isin("MID", "FWD"), F.col("total"))), 6).alias("front_total"), best.alias("best"),
    )


@query(f"""with g as (select {_GROUP} as grp, total, base_rating, start_prob from v_squad), u as (select grp, 'total' as axis, total as v from g union all select grp, 'base_rating', base_rating from g union all select grp, 'start_prob', start_prob from g)
select grp, axis, round(coalesce(max(case when v > 0 then v end), 1), 9) as top from u group by 1, 2""")
def a10_axis_maxima(spark, sf):
    g = t.squads(spark, sf).select(rules.lookup(F.col("pos"), dims.POSITION_GROUP).alias("grp"), "total", "base_rating", "start_prob")
    long = g.unpivot("grp", ["total", "base_rating", "start_prob"], "axis", "v")
    return long.groupBy("grp", "axis").agg(F.round(F.coalesce(F.max(F.when(F.col("v") > 0, F.col("v"))), F.lit(1.0)), 9).alias("top"))


@query("""select squad_id, team_id, string_agg(cast(player_id as varchar), ',' order by k) as players, count(*) as n from v_squad group by 1, 2""")
def a19_team_lists(spark, sf):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("k", "player_id"))), lambda x: x["player_id"].cast("string"))
    return t.squads(spark, sf).groupBy("squad_id", "team_id").agg(F.array_join(ordered, ",").alias("players"), F.count(F.lit(1)).alias("n"))


@query("""with r as (select squad_id, player_id, row_number() over (partition by squad_id order by total desc, k) as no from v_squad where pos = 'GK') select squad_id, player_id from r where no = 1""")
def t02_best_keeper(spark, sf):
    best = F.max(F.struct("total", (-F.col("k")).alias("o"), "player_id"))["player_id"]
    return t.squads(spark, sf).filter("pos = 'GK'").groupBy("squad_id").agg(best.alias("player_id"))


@query("""with s as (select squad_id, player_id, k, total, case when k % 4 = 0 then 0 when player_id % 9 = 0 then 3 when start_prob < 0.6 then 2 else 1 end as tier from v_squad)
select squad_id, player_id, tier, row_number() over (partition by squad_id order by tier, total desc, k) as no from s""")
def t03_display_order(spark, sf):
    tier = F.when(F.col("k") % 4 == 0, 0).when(F.col("player_id") % 9 == 0, 3).when(F.col("start_prob") < 0.6, 2).otherwise(1)
    w = Window.partitionBy("squad_id").orderBy("tier", F.desc("total"), "k")
    return t.squads(spark, sf).withColumn("tier", tier).select("squad_id", "player_id", "tier", F.row_number().over(w).alias("no"))


@query(f"""with g as (select *, {_GROUP} as grp from v_squad) select squad_id, player_id, row_number() over (partition by squad_id order by case grp when 'GK' then 0 when 'DEF' then 1 when 'MID' then 2 else 3 end, k) as no from g""")
def t04_group_order(spark, sf):
    rank = rules.lookup(rules.lookup(F.col("pos"), dims.POSITION_GROUP), dims.GROUP_ORDER)
    return t.squads(spark, sf).select("squad_id", "player_id", F.row_number().over(Window.partitionBy("squad_id").orderBy(rank, "k")).alias("no"))


@query("""select c_custkey, c_name from customer order by c_name, c_custkey limit 12 offset 24""")
def t06_third_page(spark, sf):
    return t.read(spark, sf, "customer", "c_custkey", "c_name").orderBy("c_name", "c_custkey").offset(24).limit(12)


@query("""select c_custkey, rank from (select c_custkey, row_number() over (partition by c_nationkey order by coalesce(case when c_acctbal < 0 then null else c_acctbal end, -1) desc, c_custkey) as rank from customer)""")
def t01_w24_stat_rank(spark, sf):
    stat = F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.lit(-1.0))
    w = Window.partitionBy("c_nationkey").orderBy(stat.desc(), "c_custkey")
    return t.read(spark, sf, "customer").select("c_custkey", F.row_number().over(w).alias("rank"))


@query(f"""with g as (select *, {_GROUP} as grp from v_squad), c as (select squad_id, count(*) as n, count(distinct player_id) as d, count(*) filter (where grp = 'GK') as gk, count(*) filter (where total > 54.8) as odd from g group by 1)
select squad_id, case when n <> 26 then 'size' when odd > 0 then 'player' when d <> n then 'duplicate' when gk <> 3 then 'keepers' else 'ok' end as verdict from c""")
def p17_squad_validation(spark, sf):
    c = t.squads(spark, sf).groupBy("squad_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("player_id").alias("d"), F.count_if(F.col("pos") == "GK").alias("gk"), F.count_if(F.col("total") > 54.8).alias("odd")
    )
    verdict = F.when(F.col("n") != 26, "size").when(F.col("odd") > 0, "player").when(F.col("d") != F.col("n"), "duplicate").when(F.col("gk") != 3, "keepers").otherwise("ok")
    return c.select("squad_id", verdict.alias("verdict"))


@query("""select squad_id, player_id, case when total >= 31 then 'top' when total >= 18 then 'good' when total >= 6 then 'fair' else 'low' end as score_tier,
 case when base_rating >= 8 then 'A' when base_rating >= 7.5 then 'B' when base_rating >= 7 then 'C' when base_rating >= 6.5 then 'D' else 'E' end as rating_tier from v_squad""")
def p22_tiers(spark, sf):
    return t.squads(spark, sf).select("squad_id", "player_id", rules.score_tier(F.col("total")).alias("score_tier"), rules.rating_tier(F.col("base_rating")).alias("rating_tier"))


_BONUS = "case when list_has_any(p, ['ST', 'FW']) then 2.0 when list_has_any(p, ['AM', 'W']) then 2.5 else 3.0 end"


@query(f"""with x as (select player_id, [pos, case when k % 2 = 0 then 'DM' else 'ST' end] as p, pos from v_squad)
select player_id, cast({_BONUS} as double) as goal, cast(case when pos = 'GK' then 1.5 when pos in ('RB', 'CB', 'LB') then 1 when pos in ('WB', 'DM') then 0.5 else 0 end as double) as primary_cs,
 cast(greatest(case when pos = 'GK' then 1.5 when pos in ('RB', 'CB', 'LB') then 1 when pos in ('WB', 'DM') then 0.5 else 0 end, case when p[2] = 'DM' then 0.5 else 0 end) as double) as best_cs from x""")
def f30_f31_bonuses(spark, sf):
    p = F.array("pos", F.when(F.col("k") % 2 == 0, "DM").otherwise("ST"))
    return t.squads(spark, sf).select("player_id", rules.goal_bonus(p).alias("goal"), rules.cs_bonus_primary(p).alias("primary_cs"), rules.cs_bonus_best(p).alias("best_cs"))


def _w(name: str) -> str:
    i = dims.WEIGHT_NAMES.index(name)
    return "case grp " + " ".join(f"when '{g}' then {w[i]}" for g, w in dims.WEIGHTS.items()) + " end"


_EXPECTED = f"""{_w('intercept')} + {_w('rating')} * 6.0 + {_w('rating')} * (base_rating - 6.0) + {_w('win_prob')} * win + {_w('opp_win_prob')} * loss + {_w('draw_prob')} * 0.28 + cs * ({_w('cs_win')} * win + {_w('cs_opp_win')} * loss)
 + {_w('xg_goal_bonus')} * 0.2 * gb + {_w('assist')} * 0.1 + {_w('chance_created')} * 1.1 + {_w('big_chance')} * 0.3"""


@query(f"""with x as (select *, {_GROUP} as grp, 0.2 + (k % 5) / 10.0 as win, 0.6 - (k % 5) / 10.0 as loss, case when pos = 'GK' then 1.5 when pos in ('RB', 'CB', 'LB') then 1 when pos in ('WB', 'DM') then 0.5 else 0 end as cs,
 case when pos in ('ST', 'FW') then 2.0 when pos in ('AM', 'W') then 2.5 else 3.0 end as gb, case when k % 11 = 3 then 'injured' end as status from v_squad), e as (select *, {_EXPECTED} as e, case when k % 3 = 0 then 0.6 * 0.75 + 0.4 * start_prob when k % 3 = 1 then start_prob else 0.5 end as p from x)
select squad_id, player_id, round(e, 6) as expected, round(p, 6) as p_start, round(case when status = 'injured' then -999 else greatest(0, 15 * p * (e - 5)) end, 6) as total from e""")
def f40_j01_scores(spark, sf):
    c, k = F.col, F.col("k")
    group = rules.lookup(c("pos"), dims.POSITION_GROUP)
    own = F.array("pos")
    context = (F.lit(0.2) + (k % 5) / 10.0, F.lit(0.6) - (k % 5) / 10.0, F.lit(dims.DEFAULT_DRAW))
    e = rules.expected_points(group, c("base_rating"), context, rules.cs_bonus_primary(own), rules.goal_bonus(own), F.lit(0.2), F.lit(0.1), F.lit(1.1), F.lit(0.3))
    pct = F.when(k % 3 == 0, 75.0).when(k % 3 == 2, 50.0)
    start = rules.chosen_start(c("start_prob"), pct, F.when(k % 3 == 0, "suggested").otherwise("manual"), F.lit(True))
    total = rules.total_score(start, e["expected"], k % 11 == 3)
    return t.squads(spark, sf).select("squad_id", "player_id", F.round(e["expected"], 6).alias("expected"), F.round(start, 6).alias("p_start"), F.round(total, 6).alias("total"))


@query("""with c as (select c_custkey as player_id, c_acctbal as rating, c_nationkey as team from customer), r as (select o_custkey as player_id, case when count(*) % 4 = 0 then null else count(*) * 1.0 end as rating from orders where o_orderpriority like '1%' group by 1),
x as (select o_custkey as player_id, max(case when o_orderstatus = 'F' then o_totalprice end) as rating from orders where o_custkey % 5 = 0 group by 1)
select c.player_id, c.team, round(coalesce(x.rating, case when r.player_id is not null then r.rating else c.rating end), 6) as rating from c left join r using (player_id) left join x using (player_id)""")
def j02_overlay(spark, sf):
    team = t.read(spark, sf, "customer", F.col("c_custkey").alias("player_id"), F.col("c_acctbal").alias("rating"), F.col("c_nationkey").alias("team"))
    orders = t.read(spark, sf, "orders", F.col("o_custkey").alias("player_id"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    n = F.count(F.lit(1))
    ratings = orders.filter("o_orderpriority like '1%'").groupBy("player_id").agg(F.when(n % 4 != 0, n.cast("double")).alias("rating"))
    extra = orders.filter("player_id % 5 = 0").groupBy("player_id").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("rating"))
    return joins.overlay(team, ratings, extra, "player_id", ["rating"], ["rating"]).select("player_id", "team", F.round("rating", 6).alias("rating"))


@query("""with s as (select c_custkey as player_id from customer where c_custkey % 2 = 0), a as (select o_custkey as player_id, case when count(*) % 3 > 0 then count(*) end as matches from orders where o_custkey % 3 = 0 group by 1),
b as (select o_custkey as player_id, cast(sum(o_orderkey % 700) as bigint) as minutes from orders where o_custkey % 5 <> 0 group by 1), j as (select coalesce(a.player_id, b.player_id) as player_id, a.matches, b.minutes from a full join b on a.player_id = b.player_id)
select player_id, coalesce(matches, case when minutes > 0 then cast(greatest(1, floor(minutes / 90.0 + 0.5)) as bigint) end) as matches, minutes from j where player_id in (select player_id from s)""")
def j03_prior_stats(spark, sf):
    squad = t.read(spark, sf, "customer", F.col("c_custkey").alias("player_id")).filter("player_id % 2 = 0")
    orders = t.read(spark, sf, "orders", F.col("o_custkey").alias("player_id"), "o_orderkey")
    n = F.count(F.lit(1))
    a = orders.filter("player_id % 3 = 0").groupBy("player_id").agg(F.when(n % 3 > 0, n).alias("matches"))
    b = orders.filter("player_id % 5 <> 0").groupBy("player_id").agg(F.sum(F.col("o_orderkey") % 700).alias("minutes"))
    return joins.prior_stats(squad, a, b, "player_id").select("player_id", "matches", "minutes")


@query("""with n as (select n_name, min(n_nationkey) as id from nation group by 1) select c_custkey as player_id, coalesce(nullif(case when c_custkey % 4 = 0 then 0 else c_nationkey end, 0), n.id) as team_id from customer left join nation m on m.n_nationkey = c_nationkey left join n on n.n_name = m.n_name""")
def j05_team_by_name(spark, sf):
    nation = t.read(spark, sf, "nation", "n_nationkey", "n_name")
    names = nation.groupBy("n_name").agg(F.min("n_nationkey").alias("id"))
    rows = t.read(spark, sf, "customer", "c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(names, "n_name", "left")
    own = F.when(F.col("c_custkey") % 4 == 0, 0).otherwise(F.col("c_nationkey"))
    return rows.select(F.col("c_custkey").alias("player_id"), F.coalesce(F.nullif(own, F.lit(0)), F.col("id")).alias("team_id"))


@query("""with c as (select squad_id, count(*) filter (where k % 2 = 1) as xi, count(*) filter (where k % 2 = 1 and pos = 'GK') as gk, sum(case when k % 2 = 1 then (case when k % 3 = 0 then total else greatest(0.0, total - 22.5 * start_prob) end) else 0 end) as est from v_squad where k < 22 group by 1)
select squad_id, xi, gk, xi = 11 and gk = 1 as valid, round(est, 6) as est from c""")
def p30_a30_chosen_team(spark, sf):
    chosen = F.col("k") % 2 == 1
    worth = rules.effective(F.col("total"), F.when(F.col("k") % 3 == 0, 0.0).otherwise(-1.5), F.col("start_prob"))
    c = t.squads(spark, sf).filter("k < 22").groupBy("squad_id").agg(F.count_if(chosen).alias("xi"), F.count_if(chosen & (F.col("pos") == "GK")).alias("gk"), F.sum(F.when(chosen, worth).otherwise(0.0)).alias("est"))
    return c.select("squad_id", "xi", "gk", ((F.col("xi") == 11) & (F.col("gk") == 1)).alias("valid"), F.round("est", 6).alias("est"))


@query("""with p as (select c_custkey, 1.1 + (c_custkey % 13) / 4.0 as home, case when c_custkey % 6 = 0 then null else 2.5 + (c_custkey % 4) / 2.0 end as draw, 1.2 + (c_custkey % 11) / 3.0 as away from customer),
m as (select *, least(case when home > 1 then home end, case when draw > 1 then draw end, case when away > 1 then away end) as low from p)
select c_custkey as match_id, cast(floor(100 / home + 0.5) as bigint) as win_pct, case when 100 / home >= 65 then 5 when 100 / home >= 50 then 4 when 100 / home >= 35 then 3 when 100 / home >= 20 then 2 else 1 end as ease, home = low as home_likely, coalesce(draw = low, false) as draw_likely, away = low as away_likely from m""")
def p20_p21_odds_view(spark, sf):
    k = F.col("c_custkey")
    rows = t.read(spark, sf, "customer", "c_custkey").withColumns({"home": F.lit(1.1) + (k % 13) / 4.0, "draw": F.when(k % 6 != 0, F.lit(2.5) + (k % 4) / 2.0), "away": F.lit(1.2) + (k % 11) / 3.0})
    low = F.array_min(F.filter(F.array("home", "draw", "away"), lambda x: x > 1))
    pct = 100 / F.col("home")
    ease = F.when(pct >= 65, 5).when(pct >= 50, 4).when(pct >= 35, 3).when(pct >= 20, 2).otherwise(1)
    likely = [F.coalesce(F.col(c) == low, F.lit(False)).alias(f"{c}_likely") for c in ("home", "draw", "away")]
    return rows.select(k.alias("match_id"), rules.half_up(pct).cast("long").alias("win_pct"), ease.alias("ease"), *likely)


@query("""with a as (select squad_id, player_id, [pos, case when k % 2 = 0 then 'DM' else pos end] as x, case when k % 3 = 0 then ['DM', pos] else [pos] end as y from v_squad)
select squad_id, player_id, len(list_distinct(x)) = len(list_distinct(y)) and len(list_distinct(x)) = len(list_intersect(x, y)) as same, list_has_any(x, y) as overlap from a""")
def z05_z06_position_sets(spark, sf):
    x = F.array_distinct(F.array("pos", F.when(F.col("k") % 2 == 0, "DM").otherwise(F.col("pos"))))
    y = F.array_distinct(F.when(F.col("k") % 3 == 0, F.array(F.lit("DM"), F.col("pos"))).otherwise(F.array("pos")))
    same = (F.size(x) == F.size(y)) & (F.size(F.array_except(x, y)) == 0)
    return t.squads(spark, sf).select("squad_id", "player_id", same.alias("same"), F.arrays_overlap(x, y).alias("overlap"))
