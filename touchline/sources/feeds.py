"""Nested JSON feeds to flat tables.  Each takes a DataFrame with a string column ``doc`` and an id to carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline import dims
from touchline.functions import rules

_TEAM = "struct<id: string, name: string, score: int>"
_MATCH = f"struct<id: string, round: string, roundName: string, home: {_TEAM}, away: {_TEAM}, status: struct<utcTime: string, finished: boolean, scoreStr: string>>"
_ROW = "struct<id: string, name: string, shortName: string>"
LEAGUE = (
    f"struct<matches: struct<allMatches: array<{_MATCH}>, firstUnplayedMatch: struct<firstUnplayedMatchId: string>>, "
    f"table: array<struct<data: struct<table: struct<`all`: array<{_ROW}>>, tables: array<struct<table: struct<`all`: array<{_ROW}>>>>>>>, "
    "allAvailableSeasons: array<string>, details: struct<selectedSeason: string>>"
)
STATS = "struct<TopLists: array<struct<StatName: string, StatList: array<struct<ParticiantId: long, StatValue: double, SubStatValue: double, Rank: int, MatchesPlayed: int, MinutesPlayed: int>>>>>"
ODDS = "struct<markets: array<struct<selections: array<struct<name: string, oddsDecimal: string>>>>>"
EVENTS = "struct<events: array<struct<type: string, card: string, time: int, playerId: long, nameStr: string, player: struct<id: long, name: string>>>>"
SQUAD = "struct<squad: array<struct<title: string, members: array<struct<id: long, name: string, rating: double, goals: int, injured: boolean, positionIdsDesc: string>>>>, lineup: struct<starters: array<struct<id: long, name: string, positionId: int, usualPlayingPositionId: int>>, subs: array<struct<id: long, name: string, positionId: int, usualPlayingPositionId: int>>>>"
RECENT = "array<struct<id: string, date: string, rating: string, goals: int, minutesPlayed: int, playedInMatch: boolean, onBench: boolean, isHomeTeam: boolean, homeScore: int, awayScore: int>>"


def parsed(df: DataFrame, schema: str) -> DataFrame:
    return df.withColumn("j", F.from_json("doc", schema))


def _int(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def positive_int(c: Column) -> Column:
    """Digits only, above zero, within the exact range of doubles; else null."""
    n = F.when(c.rlike(r"^\d+$"), c.try_cast("bigint"))
    return F.when((n > 0) & (n <= (1 << 53) - 1), n)


def league_matches(df: DataFrame) -> DataFrame:
    """(league, match_id, date, round, home_id, away_id, home_score, away_score, finished) of league documents.

    Rows without both team ids are dropped; a score text of two parts goes before the teams' own scores.
    """
    m = parsed(df, LEAGUE).select("league", F.posexplode("j.matches.allMatches").alias("ord", "m"))
    id_ = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))
    parts = F.split("m.status.scoreStr", "-")
    score = lambda i, side: F.when(F.size(parts) == 2, _int(F.get(parts, F.lit(i)))).otherwise(F.col(f"m.{side}.score"))
    return m.filter((id_("m.home.id") != 0) & (id_("m.away.id") != 0)).select(
        "league", "ord", F.col("m.id").try_cast("bigint").alias("match_id"), F.try_to_timestamp(F.col("m.status.utcTime")).alias("date"), F.coalesce("m.round", "m.roundName").alias("round"),
        id_("m.home.id").alias("home_id"), id_("m.away.id").alias("away_id"), score(0, "home").alias("home_score"), score(1, "away").alias("away_score"), F.coalesce("m.status.finished", F.lit(False)).alias("finished"),
    )


def current_round(df: DataFrame) -> DataFrame:
    """(league, round) of the match that the league names as its first unplayed."""
    j = parsed(df, LEAGUE)
    first = F.col("j.matches.firstUnplayedMatch.firstUnplayedMatchId")
    hit = F.get(F.filter("j.matches.allMatches", lambda m: m["id"] == first), F.lit(0))
    return j.select("league", F.coalesce(hit["round"], hit["roundName"]).alias("round"))


def table_rows(df: DataFrame) -> DataFrame:
    """(league, position, team_id): one table or several, a team's first row counts."""
    t = F.col("j.table")[0]["data"]
    several = F.flatten(F.transform(t["tables"], lambda x: x["table"]["all"]))
    rows = parsed(df, LEAGUE).select("league", F.posexplode(F.coalesce(t["table"]["all"], several)).alias("ord", "r"))
    w = Window.partitionBy("league", "team_id")
    rows = rows.select("league", "ord", F.col("r.id").try_cast("bigint").alias("team_id")).withColumn("first", F.min("ord").over(w)).filter("ord = first")
    return rows.select("league", F.row_number().over(Window.partitionBy("league").orderBy("ord")).alias("position"), "team_id")


def seasons(df: DataFrame) -> DataFrame:
    """(league, season, previous): the label after the selected one in a list from new to old."""
    all_, own = F.col("j.allAvailableSeasons"), F.col("j.details.selectedSeason")
    return parsed(df, LEAGUE).select("league", own.alias("season"), F.try_element_at(all_, (F.array_position(all_, own) + 1).cast("int")).alias("previous"))


def stat_list(df: DataFrame, by_sub: Column | None = None) -> DataFrame:
    """(list_name, player_id, value) of the first list of each document; later rows of a player overwrite."""
    sub = F.col("use_sub") if by_sub is None else by_sub
    rows = parsed(df, STATS).select("list_name", sub.alias("sub"), F.posexplode(F.get("j.TopLists", F.lit(0))["StatList"]).alias("ord", "s"))
    value = F.when(F.col("sub"), F.coalesce("s.SubStatValue", "s.StatValue")).otherwise(F.coalesce("s.StatValue", "s.SubStatValue"))
    rows = rows.select("list_name", "ord", F.col("s.ParticiantId").alias("player_id"), value.alias("value")).filter("value is not null")
    last = Window.partitionBy("list_name", "player_id").orderBy(F.desc("ord"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("list_name", "player_id", "value")


def season_stats(lists: DataFrame) -> DataFrame:
    """Lists (list_name, player_id, value) as one row for each player, a column for each known list."""
    config = lists.sparkSession.createDataFrame([(a, b) for a, b, _ in dims.STAT_LISTS], "list_name string, field string")
    fields = [b for _, b, _ in dims.STAT_LISTS]
    return lists.join(F.broadcast(config), "list_name").groupBy("player_id").pivot("field", fields).agg(F.first("value", ignorenulls=True))


def rating_list(df: DataFrame) -> DataFrame:
    hit = F.get(F.filter("j.TopLists", lambda x: x["StatName"] == "rating"), F.lit(0))["StatList"]
    return parsed(df, STATS).select(F.inline(hit)).select(F.col("ParticiantId").alias("player_id"), F.col("Rank").alias("league_rank"), F.col("MatchesPlayed").alias("matches"), F.col("MinutesPlayed").alias("minutes"), F.col("StatValue").alias("rating"))


def card_events(df: DataFrame) -> DataFrame:
    rows = parsed(df, EVENTS).select("match_id", F.explode("j.events").alias("e"))
    rows = rows.filter((F.col("e.type") == "Card") & F.col("e.card").isin("Yellow", "Red", "YellowRed"))
    rows = rows.select("match_id", F.coalesce("e.playerId", "e.player.id").alias("player_id"), F.coalesce("e.nameStr", "e.player.name", F.lit("")).alias("player_name"), F.col("e.card").alias("card"), F.coalesce("e.time", F.lit(0)).alias("minute"))
    return rows.filter("player_id is not null")


def match_odds(df: DataFrame) -> DataFrame:
    """(match_id, home, draw, away) of the first market, where it has any price."""
    rows = parsed(df, ODDS).select("match_id", F.inline(F.get("j.markets", F.lit(0))["selections"]))
    price = F.regexp_extract(F.col("oddsDecimal"), r"^\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")
    pick = lambda name: F.max(F.when(F.lower("name") == name, price))
    return rows.groupBy("match_id").agg(pick("1").alias("home"), pick("x").alias("draw"), pick("2").alias("away")).filter("coalesce(home, draw, away) is not null")


def full_odds(df: DataFrame) -> DataFrame:
    """Odds with all three prices, as saved odds are kept."""
    return match_odds(df).filter("home is not null and draw is not null and away is not null")


def team_players(df: DataFrame) -> DataFrame:
    """(team, player_id, name, grp, rating, goals, injured): squads by group title (others, as coaches, are dropped), else the last line-up."""
    groups = df.sparkSession.createDataFrame([("keepers", "GK"), ("defenders", "DEF"), ("midfielders", "MID"), ("attackers", "FWD")], "title string, grp string")
    j = parsed(df, SQUAD)
    listed = j.filter("j.squad is not null").select("team", F.explode("j.squad").alias("g")).select("team", F.col("g.title").alias("title"), F.explode("g.members").alias("m"))
    listed = listed.join(F.broadcast(groups), "title").select("team", F.col("m.id").alias("player_id"), F.coalesce("m.name", F.lit("")).alias("name"), "grp", "m.rating", F.coalesce("m.goals", F.lit(0)).alias("goals"), F.coalesce("m.injured", F.lit(False)).alias("injured"))
    line = j.filter("j.squad is null").select("team", F.posexplode(F.concat("j.lineup.starters", "j.lineup.subs")).alias("ord", "m"))
    w = Window.partitionBy("team", "m.id").orderBy("ord")
    line = line.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    usual = F.coalesce("m.usualPlayingPositionId", F.when(F.col("m.positionId") == 11, 0))
    group = F.when(usual == 0, "GK").when(usual == 1, "DEF").when(usual == 3, "FWD").otherwise("MID")
    line = line.select("team", F.col("m.id").alias("player_id"), F.coalesce("m.name", F.lit("")).alias("name"), group.alias("grp"), F.lit(None).cast("double").alias("rating"), F.lit(0).alias("goals"), F.lit(False).alias("injured"))
    return listed.unionByName(line)


def recent_matches(df: DataFrame) -> DataFrame:
    """(player_id, ord, match_id, result, minutes, rating, goals, started) of player documents."""
    rows = parsed(df, RECENT).select("player_id", F.posexplode("j").alias("ord", "m"))
    own, other = F.when(F.col("m.isHomeTeam"), F.col("m.homeScore")).otherwise(F.col("m.awayScore")), F.when(F.col("m.isHomeTeam"), F.col("m.awayScore")).otherwise(F.col("m.homeScore"))
    rating, minutes = F.col("m.rating").try_cast("double"), F.col("m.minutesPlayed")
    started = F.coalesce("m.playedInMatch", F.lit(False)) & ~F.coalesce("m.onBench", F.lit(False)) & (minutes.isNull() | (minutes > 45))
    return rows.select("player_id", "ord", F.col("m.id").alias("match_id"), F.when(own > other, "W").when(own == other, "D").otherwise("L").alias("result"), minutes.alias("minutes"), F.when(rating > 0, rating).alias("rating"), F.coalesce("m.goals", F.lit(0)).alias("goals"), started.alias("started"))


def flat_numbers(df: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """(key, name, value): numeric entries of a flat JSON object."""
    return df.select(key, F.explode(F.from_json(doc, "map<string, string>")).alias("name", "raw")).select(key, "name", F.col("raw").try_cast("double").alias("value")).filter("value is not null")


def scoring_side(events: DataFrame) -> DataFrame:
    """(match_id, ord, side) of goals from the running score; a home rise goes first; null where no side's score rose."""
    w = Window.partitionBy("match_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("home_score").isNotNull() & F.col("away_score").isNotNull(), F.struct("home_score", "away_score"))
    before = F.last(known, ignorenulls=True).over(w)
    h, a = F.coalesce(before["home_score"], F.lit(0)), F.coalesce(before["away_score"], F.lit(0))
    return events.withColumn("side", F.when(F.col("home_score") > h, "h").when(F.col("away_score") > a, "a"))


TEAM_SEASONS = "struct<stats: struct<primarySeasonId: string, tournamentSeasons: array<struct<tournamentId: string, parentLeagueId: string>>>>"
XG = "struct<content: struct<stats: struct<Periods: struct<`All`: struct<stats: array<struct<stats: array<struct<key: string, stats: array<string>>>>>>>>>>"
SUGGEST = "array<struct<title: struct<key: string>, suggestions: array<struct<type: string, id: long, name: string, teamId: long, teamName: string>>>>"
PLAYER = (
    "struct<primaryTeam: struct<teamId: long, teamName: string>, positionDescription: struct<primaryPosition: struct<label: string>, "
    "positions: array<struct<strPos: struct<label: string>, strPosShort: struct<label: string>>>>, firstSeasonStats: struct<statsSection: struct<items: array<struct<"
    "title: string, localizedTitleId: string, display: string, items: array<struct<title: string, localizedTitleId: string, statValue: string, per90: double, percentileRank: double, statFormat: string>>>>>>>"
)
NATIVES = "struct<data: array<struct<id: long, name: string, first_name: string, club: struct<name: string>, position_classic_arr: array<string>>>, meta: struct<page: struct<total_pages: int>>>"
#: Short position labels by group; any other is a midfielder's.
SHORT_POSITION = {"GK": "GK", "CB": "DEF", "LB": "DEF", "RB": "DEF", "LWB": "DEF", "RWB": "DEF", "DM": "MID", "CM": "MID", "LM": "MID", "RM": "MID", "AM": "MID", "LW": "FWD", "RW": "FWD", "ST": "FWD", "CF": "FWD", "SS": "FWD"}


def season_ids(df: DataFrame) -> DataFrame:
    """(league, season_id, previous_id) from a team's document: the league's own season after the primary one in a list from new to old."""
    j = parsed(df, TEAM_SEASONS)
    own = F.transform(F.filter("j.stats.tournamentSeasons", lambda s: s["parentLeagueId"] == F.col("league").cast("string")), lambda s: s["tournamentId"])
    place = F.array_position(own, F.col("j.stats.primarySeasonId")).cast("int")
    return j.select("league", F.col("j.stats.primarySeasonId").alias("season_id"), F.when(place > 0, F.try_element_at(own, place + 1)).alias("previous_id"))


def league_teams(df: DataFrame, logo: str = "/logo/%d.png") -> DataFrame:
    """(league, position, team_id, logo) of a league's table."""
    return table_rows(df).withColumn("logo", F.format_string(logo, "team_id"))


def match_xg(df: DataFrame) -> DataFrame:
    """(match_id, hx, ax): the first expected-goals row whose two values are both finite numbers; nulls without one."""
    rows = F.flatten(F.transform("j.content.stats.Periods.All.stats", lambda g: F.coalesce(g["stats"], F.array())))
    number = lambda r, i: F.get(r["stats"], F.lit(i)).try_cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    hit = F.get(F.filter(rows, lambda r: (r["key"] == "expected_goals") & finite(number(r, 0)) & finite(number(r, 1))), F.lit(0))
    return parsed(df, XG).withColumn("hit", hit).select("match_id", number(F.col("hit"), 0).alias("hx"), number(F.col("hit"), 1).alias("ax"))


def search_players(df: DataFrame) -> DataFrame:
    """(term, ord, player_id, name, team_id, team_name) of suggestions: the group of players, else the first group; players only."""
    group = F.coalesce(F.get(F.filter("j", lambda g: g["title"]["key"] == "players"), F.lit(0)), F.get("j", F.lit(0)))
    rows = parsed(df, SUGGEST).select("term", F.posexplode(F.filter(group["suggestions"], lambda s: s["type"] == "player")).alias("ord", "s"))
    return rows.select("term", "ord", F.col("s.id").alias("player_id"), F.coalesce("s.name", F.lit("")).alias("name"), F.coalesce("s.teamId", F.lit(0)).alias("team_id"), F.coalesce("s.teamName", F.lit("")).alias("team_name"))


def current_team(df: DataFrame) -> DataFrame:
    """(player_id, team_id, team_name) of players with a current club."""
    team = F.col("j.primaryTeam")
    known = (F.coalesce(team["teamId"], F.lit(0)) != 0) & (F.coalesce(team["teamName"], F.lit("")) != "")
    return parsed(df, PLAYER).filter(known).select("player_id", team["teamId"].alias("team_id"), team["teamName"].alias("team_name"))


def primary_position(df: DataFrame) -> DataFrame:
    """(player_id, label, grp): the short label of the primary position; players without one are left out."""
    j = F.col("j.positionDescription")
    hit = F.get(F.filter(j["positions"], lambda p: p["strPos"]["label"] == j["primaryPosition"]["label"]), F.lit(0))
    label = F.upper(F.coalesce(hit["strPosShort"]["label"], F.lit("")))
    return parsed(df, PLAYER).select("player_id", label.alias("label")).filter("label <> ''").withColumn("grp", rules.lookup(F.col("label"), SHORT_POSITION, "MID"))


def rich_stats(df: DataFrame) -> DataFrame:
    """(player_id, grp, ord, title, value, per90, percentile, format) of stat groups that have items."""
    groups = F.filter("j.firstSeasonStats.statsSection.items", lambda g: (g["display"] == "stats-group") & (F.size(F.coalesce(g["items"], F.array())) > 0))
    rows = parsed(df, PLAYER).select("player_id", F.explode(groups).alias("g")).select("player_id", F.coalesce("g.title", F.lit("")).alias("grp"), F.posexplode("g.items").alias("ord", "i"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("player_id", "grp", "ord", text("i.title").alias("title"), text("i.statValue").alias("value"), F.coalesce("i.per90", F.lit(0.0)).alias("per90"), F.coalesce("i.percentileRank", F.lit(0.0)).alias("percentile"), F.coalesce("i.statFormat", F.lit("number")).alias("format"))


def tournament_players(df: DataFrame) -> DataFrame:
    """(tournament, native_id, full_name, club, positions) of pages (tournament, page, doc), up to the first page that is missing or beyond the last."""
    j = parsed(df, NATIVES)
    before = Window.partitionBy("tournament").orderBy("page")
    total = F.first("total", ignorenulls=False).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pages = j.filter("j is not null").select("tournament", "page", "j", F.coalesce("j.meta.page.total_pages", F.lit(1)).alias("total"))
    pages = pages.withColumn("place", F.row_number().over(before)).withColumn("pages", total).filter("page = place and page <= pages")
    rows = pages.select("tournament", F.explode("j.data").alias("r"))
    full = F.concat_ws(" ", F.nullif(F.col("r.first_name"), F.lit("")), F.nullif(F.col("r.name"), F.lit("")))
    return rows.select("tournament", F.col("r.id").alias("native_id"), full.alias("full_name"), F.coalesce("r.club.name", F.lit("")).alias("club"), F.coalesce("r.position_classic_arr", F.array().cast("array<string>")).alias("positions"))


def player_record(players: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """A player's record of all season statistics: those that ``players`` has, and typed nulls for the others."""
    fields = [f for _, f, _ in dims.STAT_LISTS]
    return players.select(*(c for c in players.columns if c not in fields), *((F.col(f) if f in known else F.lit(None)).cast("double").alias(f) for f in fields))


def landed_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Match documents landed as JSON files, one to a line: those with a date and both scores."""
    rows = spark.read.schema("id long, date string, hs int, as_ int").json(folder)
    return rows.withColumn("date", F.try_to_timestamp("date")).filter("date is not null and hs is not null and as_ is not null")


_LINE = "array<struct<id: long, name: string, positionId: int, usualPlayingPositionId: int, performance: struct<rating: double, substitutionEvents: array<struct<type: string, time: int>>>>>"
_SIDE = f"struct<id: long, starters: {_LINE}, subs: {_LINE}>"
DETAIL = f"struct<general: struct<matchId: string, matchTimeUTCDate: string, finished: boolean>, content: struct<lineup: struct<homeTeam: {_SIDE}, awayTeam: {_SIDE}>, matchFacts: struct<events: struct<events: array<struct<type: string, time: int, homeScore: int, awayScore: int, ownGoal: boolean, goalDescription: string, player: struct<id: long>>>>>>>"


def match_players(df: DataFrame) -> DataFrame:
    """(match_id, team_id, is_home, started, player_id, slot, usual, rating, t_in, t_out) of match details: starters and substitutes of both sides."""
    line = F.col("j.content.lineup")
    sides = [F.struct(line[side]["id"].alias("team_id"), F.lit(home).alias("is_home"), F.lit(started).alias("started"), line[side][part].alias("players")) for side, home in (("homeTeam", 1), ("awayTeam", 0)) for part, started in (("starters", 1), ("subs", 0))]
    rows = parsed(df, DETAIL).select(F.col("j.general.matchId").try_cast("bigint").alias("match_id"), F.explode(F.array(*sides)).alias("s")).select("match_id", "s.team_id", "s.is_home", "s.started", F.explode("s.players").alias("p"))
    change = lambda kind: F.get(F.filter("p.performance.substitutionEvents", lambda e: e["type"] == kind), F.lit(0))["time"]
    return rows.select("match_id", "team_id", "is_home", "started", F.col("p.id").alias("player_id"), F.col("p.positionId").alias("slot"), F.col("p.usualPlayingPositionId").alias("usual"), F.col("p.performance.rating").alias("rating"), change("subIn").alias("t_in"), change("subOut").alias("t_out"))


def match_goals(df: DataFrame) -> DataFrame:
    """(match_id, ord, minute, side, own_goal, penalty, player_id) of match details; sides come from the running score."""
    rows = parsed(df, DETAIL).select(F.col("j.general.matchId").try_cast("bigint").alias("match_id"), F.posexplode("j.content.matchFacts.events.events").alias("ord", "e")).filter("e.type = 'Goal'")
    rows = rows.select("match_id", "ord", F.col("e.time").alias("minute"), F.col("e.homeScore").alias("home_score"), F.col("e.awayScore").alias("away_score"), F.coalesce("e.ownGoal", F.lit(False)).alias("own_goal"), F.coalesce(F.lower("e.goalDescription").contains("penalt"), F.lit(False)).alias("penalty"), F.col("e.player.id").alias("player_id"))
    return scoring_side(rows).select("match_id", "ord", "minute", "side", "own_goal", "penalty", "player_id")
