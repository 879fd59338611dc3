"""Queries on names, cards, availability and freshness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline import dims
from touchline.functions import dates, rules, text
from touchline.operators import freshness, joins
from touchline.plans.registry import query
from touchline.sources import tables as t

AS_OF = "2024-01-31 00:00:00"
_NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _sim(a: str, b: str) -> str:
    return f"case when length({a}) = 0 or length({b}) = 0 then 0.0 when {a} = {b} then 1.0 else 1 - levenshtein({a}, {b}) * 1.0 / greatest(length({a}), length({b})) end"


def _given(a: str, b: str) -> str:
    return f"case when {a} = {b} then 1.0 when (length({a}) >= 3 and starts_with({b}, {a})) or (length({b}) >= 3 and starts_with({a}, {b})) then 0.95 else {_sim(a, b)} end"


def _name(a: str, b: str) -> str:
    fa, la, fb, lb = f"split_part({a}, ' ', 1)", f"string_split({a}, ' ')[-1]", f"split_part({b}, ' ', 1)", f"string_split({b}, ' ')[-1]"
    return f"case when length({a}) = 0 or length({b}) = 0 then 0.0 else greatest(({_sim(la, lb)}) * 0.6 + ({_given(fa, fb)}) * 0.4, ({_sim(la, fb)}) * 0.6 + ({_given(fa, lb)}) * 0.4) end"


def _club(a: str, b: str) -> str:
    return f"case when length({a}) = 0 or length({b}) = 0 then 0.0 when {a} = {b} then 1.0 when contains({a}, {b}) or contains({b}, {a}) then 0.95 else {_sim(a, b)} end"


@query(f"select doc_id, {_NORM.format('text')} as name from documents")
def f01_normal_name(spark, sf):
    """Whole texts, as the longest names there are."""
    return t.read(spark, sf, "documents", "doc_id", "text").select("doc_id", text.normal_name(F.col("text")).alias("name"))


@query(f"select p_partkey, {_NORM.format("replace(p_name, ' ', '-')")} as name from part")
def f02_normal_name_compatible(spark, sf):
    return t.read(spark, sf, "part", "p_partkey", "p_name").select("p_partkey", text.normal_name_compatible(F.translate("p_name", " ", "-")).alias("name"))


_PART = "select x.p_partkey as id, lower(x.p_name) as a, lower(y.p_name) as b from part x join part y on y.p_partkey = x.p_partkey + 1"


@query(f"with x as ({_PART}), y as (select * from x where b is not null) select id, round({_sim('a', 'b')}, 9) as sim, round({_given('a', 'b')}, 9) as given, round({_name('a', 'b')}, 9) as name_sim, round({_club('a', 'b')}, 9) as club_sim from y")
def f03_f07_similarities(spark, sf):
    parts = t.read(spark, sf, "part", "p_partkey", "p_name")
    # each name and that of the key after it: an equality join rather than one global window
    nxt = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.lower("p_name").alias("b"))
    rows = parts.join(nxt, "p_partkey").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("a"), "b")
    a, b = F.col("a"), F.col("b")
    return rows.select("id", *(F.round(f(a, b), 9).alias(n) for n, f in (("sim", text.similarity), ("given", text.given_similarity), ("name_sim", text.name_similarity), ("club_sim", text.club_similarity))))


_TARGETS = """tg as (select p_partkey as target_id, case p_partkey % 4 when 0 then lower(p_name) when 1 then split_part(lower(p_name), ' ', 2) || ' ' || split_part(lower(p_name), ' ', 1)
  when 2 then left(lower(p_name), length(p_name) - 1) else 'x' || lower(p_name) end as name, lower(p_brand) as club, p_type as block from part where p_partkey % 3 > 0),
 cd as (select p_partkey as candidate_id, lower(p_name) as full_name, lower(p_brand) as club_name, p_type as block from part where p_partkey % 3 = 0)"""


def _people(spark, sf):
    """Names of parts as targets, changed a little (turned round, cut, prefixed), against those of other parts; brands are clubs."""
    part = t.read(spark, sf, "part", F.col("p_partkey").alias("id"), F.lower("p_name").alias("n"), F.lower("p_brand").alias("club"), F.col("p_type").alias("block"))
    k, n = F.col("id") % 4, F.col("n")
    turned = F.concat_ws(" ", F.substring_index(n, " ", -1), F.substring_index(n, " ", 1))
    name = F.when(k == 0, n).when(k == 1, turned).when(k == 2, F.left(n, F.length(n) - 1)).otherwise(F.concat(F.lit("x"), n))
    return (
        part.filter("id % 3 > 0").select(F.col("id").alias("target_id"), name.alias("name"), "club", "block"),
        part.filter("id % 3 = 0").select(F.col("id").alias("candidate_id"), n.alias("full_name"), F.col("club").alias("club_name"), "block"),
    )


_MATCHES = f"""{_TARGETS}, p as (select target_id, candidate_id, ({_name('name', 'full_name')}) * 0.7 + ({_club('club', 'club_name')}) * 0.3 as score from tg join cd using (block)),
r as (select *, row_number() over (partition by target_id order by score desc, candidate_id) as n from p where score > 0), found as (select target_id, candidate_id, score from r where n = 1 and score >= 0.85)"""


@query(f"with {_MATCHES} select target_id, candidate_id, round(score, 9) as score from found")
def j07_best_name_match(spark, sf):
    targets, candidates = _people(spark, sf)
    return joins.best_name_match(targets, candidates, ["block"]).withColumn("score", F.round("score", 9))


@query(f"""with {_MATCHES}, c as (select target_id, candidate_id, {_club('club', 'club_name')} as club_score from tg join cd using (block) where target_id not in (select target_id from found) and candidate_id not in (select candidate_id from found)),
b as (select * from (select *, row_number() over (partition by target_id order by club_score desc, candidate_id) as n from c where club_score >= 0.5) where n = 1)
select target_id, candidate_id, round(club_score, 9) as club_score from (select *, row_number() over (partition by candidate_id order by target_id) as m from b) where m = 1""")
def j08_import_cascade(spark, sf):
    targets, candidates = _people(spark, sf)
    found = joins.best_name_match(targets, candidates, ["block"])
    return joins.import_cascade(targets, candidates, found, ["block"]).withColumn("club_score", F.round("club_score", 9))


@query(f"""with {_TARGETS}, p as (select target_id as player_id, name, club, block, string_split(name, ' ') as w from tg where name <> ''),
 n as (select candidate_id as native_id, full_name as full, string_split(full_name, ' ')[-1] as last, string_split(full_name, ' ')[1] as first, club_name, block from cd),
 exact as (select player_id, native_id from p join n using (block) where name = "full"),
 pool as (select player_id, native_id, name, club, first, club_name from p join n using (block) where name = "full"
  or (player_id not in (select player_id from exact) and (last = name or ends_with(name, ' ' || last)))),
 a as (select *, count(*) over (partition by player_id) as c, left(first, 1) = left(name, 1) as ok from pool),
 b as (select * from (select *, bool_or(ok) over (partition by player_id) as anyone from a) where c = 1 or ok or not anyone),
 d as (select player_id, native_id, count(*) over (partition by player_id) as c, length(club_name) > 0 and (contains(club, club_name) or contains(club_name, club) or len(list_intersect(string_split(club, ' '), string_split(club_name, ' '))) > 0) as ok from b),
 e as (select * from (select *, bool_or(ok) over (partition by player_id) as anyone from d) where c = 1 or ok or not anyone)
select player_id, native_id from (select *, count(*) over (partition by player_id) as k from e) where k = 1""")
def j09_staged_match(spark, sf):
    targets, candidates = _people(spark, sf)
    players = targets.select(F.col("target_id").alias("player_id"), "name", "club", "block").filter("name <> ''")
    last, first = F.element_at(F.split("full_name", " "), -1), F.element_at(F.split("full_name", " "), 1)
    natives = candidates.select(F.col("candidate_id").alias("native_id"), F.col("full_name").alias("full"), last.alias("last"), first.alias("first"), "club_name", "block")
    return joins.staged_match(players, natives, ["block"])


@query("""with l as (select *, row_number() over (partition by player_id order by ts desc, ord desc) as back from v_card),
g as (select player_id, cast(sum(case when card = 'Yellow' then 1 else 0 end) as bigint) as yellows, max(ts) as last_card from v_card group by 1)
select g.player_id, yellows, last_card, l.card in ('Red', 'YellowRed') and l.ts >= timestamp '2024-01-31' - interval 12 day as suspended, yellows >= 4 as at_risk from g join l on l.player_id = g.player_id and l.back = 1""")
def a08_suspensions(spark, sf):
    rows = t.cards(spark, sf)
    end = F.lit(AS_OF).cast("timestamp_ntz")
    last = F.max(F.struct("ts", "ord", "card")).alias("last")
    by = rows.groupBy("player_id").agg(F.count_if(F.col("card") == "Yellow").alias("yellows"), last)
    red = F.col("last.card").isin("Red", "YellowRed") & (F.col("last.ts") >= end - F.expr("interval 12 days"))
    return by.select("player_id", "yellows", F.col("last.ts").alias("last_card"), red.alias("suspended"), (F.col("yellows") >= dims.YELLOW_BAN - 1).alias("at_risk"))


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events where event_type <> 'view')
select user_id as player_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as pos from r where back <= 5""")
def w08_last_club_matches(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = t.read(spark, sf, "events", "user_id", "ts", "event_id", "event_type").filter("event_type <> 'view'").withColumn("back", F.row_number().over(w)).filter("back <= 5")
    again = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select(F.col("user_id").alias("player_id"), "event_id", "event_type", F.row_number().over(again).alias("pos"))


@query("""with f as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events)
select user_id as player_id, cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as goals, cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) as assists,
 cast(sum(case when user_id % 10 = 0 and event_type = 'view' and value < 20 then 1 else 0 end) as bigint) as clean_sheets from f where back <= 5 group by 1""")
def a12_recent_summary(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = t.read(spark, sf, "events", "user_id", "ts", "event_id", "event_type", "value").withColumn("back", F.row_number().over(w)).filter("back <= 5")
    clean = (F.col("user_id") % 10 == 0) & (F.col("event_type") == "view") & (F.col("value") < 20)
    return rows.groupBy(F.col("user_id").alias("player_id")).agg(F.count_if(F.col("event_type") == "purchase").alias("goals"), F.count_if(F.col("event_type") == "click").alias("assists"), F.count_if(clean).alias("clean_sheets"))


_INJURED = """o as (select user_id as player_id, max(ts) as ts, arg_max(event_type = 'view', event_id) as cleared from events where event_type in ('view', 'error') group by 1),
 l as (select c_custkey as player_id, c_acctbal < 0 as injured from customer where c_custkey % 3 = 0)"""


@query(f"""with {_INJURED} select c.c_custkey as player_id, coalesce(not o.cleared, l.injured, false) as injured, case when o.player_id is not null then 'override' when l.player_id is not null then 'live' else 'none' end as source
from customer c left join o on o.player_id = c.c_custkey left join l on l.player_id = c.c_custkey""")
def j06_injuries(spark, sf):
    squad, overrides, live = _injury_tables(spark, sf)
    return joins.injuries(squad, overrides, live)


def _injury_tables(spark, sf):
    events = t.read(spark, sf, "events", "user_id", "event_id", "event_type").filter("event_type in ('view', 'error')")
    last = F.max(F.struct("event_id", (F.col("event_type") == "view").alias("cleared")))["cleared"]
    overrides = events.groupBy(F.col("user_id").alias("player_id")).agg(last.alias("cleared"))
    customers = t.read(spark, sf, "customer", F.col("c_custkey").alias("player_id"), "c_acctbal")
    live = customers.filter("player_id % 3 = 0").select("player_id", (F.col("c_acctbal") < 0).alias("injured"))
    return customers.select("player_id"), overrides, live


@query("""select event_id, case when value < 10 then false when try_cast('2024-01-' || substr('0' || cast(event_id % 35 as varchar), -2) as date) is null then true
 else try_cast('2024-01-' || substr('0' || cast(event_id % 35 as varchar), -2) as date) > date '2024-01-15' end as active, 
 coalesce(try_cast('2024-01-' || substr('0' || cast(event_id % 35 as varchar), -2) as date) = date '2024-01-15', false) as returning_today from events""")
def p08_p09_injury_dates(spark, sf):
    back = F.try_to_date(F.concat(F.lit("2024-01-"), F.substring(F.concat(F.lit("0"), (F.col("event_id") % 35).cast("string")), -2, 2)))
    today = F.lit("2024-01-15").cast("date")
    active = F.when(F.col("value") < 10, False).when(back.isNull(), True).otherwise(back > today)
    return t.read(spark, sf, "events", "event_id", "value").select("event_id", active.alias("active"), F.coalesce(back == today, F.lit(False)).alias("returning_today"))


@query(f"""with {_INJURED}, i as (select c.c_custkey as player_id, coalesce(not o.cleared, l.injured, false) as injured, case c_custkey % 7 when 0 then 'suspended' when 1 then 'manual' end as status, c_custkey % 5 * 25 as pct
 from customer c left join o on o.player_id = c.c_custkey left join l on l.player_id = c.c_custkey),
s as (select *, coalesce(status, case when injured then 'injured' end) as final from i)
select count(*) as players, count(*) filter (where final = 'injured') as injured, count(*) filter (where final = 'suspended') as suspended,
 count(*) filter (where coalesce(final, '') not in ('injured', 'suspended') and pct < 100) as doubtful,
 count(*) - count(*) filter (where final = 'injured') - count(*) filter (where final = 'suspended') - count(*) filter (where coalesce(final, '') not in ('injured', 'suspended') and pct < 100) as available from s""")
def p10_p16_availability_report(spark, sf):
    squad, overrides, live = _injury_tables(spark, sf)
    k = F.col("player_id")
    status = F.when(k % 7 == 0, "suspended").when(k % 7 == 1, "manual")
    rows = joins.injuries(squad, overrides, live).withColumn("final", F.coalesce(status, F.when(F.col("injured"), F.lit("injured")))).withColumn("pct", k % 5 * 25)
    final = F.coalesce("final", F.lit(""))
    return rows.agg(
        F.count(F.lit(1)).alias("players"), F.count_if(final == "injured").alias("injured"), F.count_if(final == "suspended").alias("suspended"), F.count_if(~final.isin("injured", "suspended") & (F.col("pct") < 100)).alias("doubtful")
    ).withColumn("available", F.col("players") - F.col("injured") - F.col("suspended") - F.col("doubtful"))


_TIERS = " union all ".join(f"select '{k}' as tier, {i} as no, {f} as fresh_ms, {s} as stale_ms" for i, (k, (f, s)) in enumerate(dims.TIERS.items()))


@query(f"""with tiers as ({_TIERS}), e as (select event_id, cast(epoch_us(timestamp '2024-01-31') - epoch_us(ts) as bigint) // 1000 % 100000000 as age, event_id % 10 as no, value > 5 as has_data, event_id % 4 = 0 as forced from events)
select event_id, tier, case when not has_data then 'fetch' when forced and age >= 30000 then 'fetch' when age < fresh_ms then 'serve' when age < stale_ms then 'refresh' else 'fetch' end as action,
 case when event_id % 3 > 0 then 'new' when has_data then 'old' else 'error' end as served from e join tiers using (no)""")
def x01_x02_freshness(spark, sf):
    names = list(dims.TIERS)
    tier = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 10 + 1).cast("int"))
    age = F.floor((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000) % 100000000
    rows = t.read(spark, sf, "events", "event_id", "ts", "value").select("event_id", tier.alias("tier"), age.alias("age"), (F.col("value") > 5).alias("has_data"), (F.col("event_id") % 4 == 0).alias("forced"))
    rows = rows.join(F.broadcast(freshness.tiers(spark)), "tier")
    act = freshness.action(F.col("age"), F.col("fresh_ms"), F.col("stale_ms"), F.col("has_data"), F.col("forced"))
    return rows.select("event_id", "tier", act.alias("action"), freshness.after_fetch(F.col("event_id") % 3 > 0, F.col("has_data")).alias("served"))


@query("""with r as (select user_id, event_type, event_id, value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) select user_id, event_type, event_id, value from r where n = 1""")
def x07_last_write(spark, sf):
    return freshness.latest(t.read(spark, sf, "events", "user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""with o as (select user_id, min(ts) as created, max(event_id) as event_id from events where event_id % 2 = 0 group by 1), n as (select user_id, max(ts) as created, max(event_id) as event_id from events where event_id % 3 = 0 and user_id % 2 = 0 group by 1)
select user_id, created, event_id from o where user_id not in (select user_id from n) union all select n.user_id, coalesce(o.created, n.created), n.event_id from n left join o on o.user_id = n.user_id""")
def s28_upsert(spark, sf):
    e = t.read(spark, sf, "events", "user_id", "ts", "event_id")
    old = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.min("ts").alias("created"), F.max("event_id").alias("event_id"))
    new = e.filter("event_id % 3 = 0 and user_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("created"), F.max("event_id").alias("event_id"))
    return freshness.upsert(old, new, ["user_id"], "created")


@query("""select user_id, event_id from events where user_id not in (select user_id from events where event_type = 'error' and value > 90)""")
def s30_keyed_delete(spark, sf):
    e = t.read(spark, sf, "events", "user_id", "event_id", "event_type", "value")
    return freshness.delete(e, e.filter("event_type = 'error' and value > 90").select("user_id").distinct(), ["user_id"]).select("user_id", "event_id")


@query("""select event_id, event_type, value from events where event_type in ('error', 'purchase') order by ts desc, event_id desc limit 50""")
def s32_t07_newest_50(spark, sf):
    e = t.read(spark, sf, "events", "event_id", "event_type", "value", "ts").filter("event_type in ('error', 'purchase')")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "value")


@query("""with e as (select event_id, ts, (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) // 1000000 as s from events)
select event_id, strftime(ts, '%Y-%m') as month, cast(make_date(cast(year(ts) - case when month(ts) < 7 then 1 else 0 end as bigint), 7, 1) as date) as season_start, round((epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 86400000000.0, 9) as age_days,
 case when s < 60 then 'just now' when s < 3600 then (s // 60) || 'm ago' when s < 86400 then (s // 3600) || 'h ago' else (s // 86400) || 'd ago' end as label from e""")
def f22_f25_dates(spark, sf):
    ts, now = F.col("ts"), F.lit(AS_OF).cast("timestamp")
    return t.read(spark, sf, "events", "event_id", "ts").select(
        "event_id", dates.month_key(ts).alias("month"), dates.season_start(ts).alias("season_start"), F.round(dates.age_days(ts, now), 9).alias("age_days"), rules.age_label(dates.age_seconds(ts, now)).alias("label")
    )


@query("""with s as (select cast(event_id as varchar) || case when event_id % 3 = 0 then 'x' when event_id % 5 = 0 then '' else '' end as raw, event_id from events) select event_id, case when regexp_full_match(raw, '\\d+') and try_cast(raw as bigint) > 0 then try_cast(raw as bigint) end as n from s""")
def p01_positive_int(spark, sf):
    from touchline.sources import feeds

    raw = F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "x").otherwise(""))
    return t.read(spark, sf, "events", "event_id").select("event_id", feeds.positive_int(raw).alias("n"))


@query("""select event_id, case event_type when 'error' then ['RB', 'WB'] when 'click' then ['DM'] when 'view' then ['ST'] when 'purchase' then ['FW'] else ['CM'] end[1] as first_position from events""")
def p06_guessed_positions(spark, sf):
    labels = {"error": ("Right Wing Back", "DEF"), "click": ("Defensive Midfielder", "MID"), "view": ("Striker", "FWD"), "purchase": ("Second Striker", "FWD"), "signup": ("Central", "MID")}
    label, group = (rules.lookup(F.col("event_type"), {k: v[i] for k, v in labels.items()}) for i in (0, 1))
    return t.read(spark, sf, "events", "event_id", "event_type").select("event_id", text.guess_positions(label, group)[0].alias("first_position"))
