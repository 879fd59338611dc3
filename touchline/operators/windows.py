"""Ordered and point-in-time operators.  Matches are in order of (dt, match_id); nothing sees its own match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import rules

ORDER = ("dt", "match_id")


def _points() -> Column:
    return F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)


def _before(*keys: str):
    return Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)


def standings_before(sides: DataFrame) -> DataFrame:
    """(match_id, team, position, n_teams) of both teams before each match.

    Points, goal difference, goals, then team id.  A grid of a league season's
    matches and teams, with running totals that leave out the match itself; its
    width is a league's number of teams.
    """
    keys = ["league", "season"]
    teams = sides.select(*keys, "team").distinct()
    games = sides.filter("is_home = 1").select(*keys, "match_id", "dt")
    own = sides.select("match_id", "team", "gf", "ga", F.lit(True).alias("plays"))
    grid = games.join(teams, keys).join(own, ["match_id", "team"], "left")
    before = _before(*keys, "team")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("plays"), c)).over(before), F.lit(0))
    grid = grid.withColumns({"pts": total(_points()), "gd": total(F.col("gf") - F.col("ga")), "goals": total(F.col("gf"))})
    place = Window.partitionBy("match_id").orderBy(F.desc("pts"), F.desc("gd"), F.desc("goals"), "team")
    every = Window.partitionBy("match_id")
    grid = grid.withColumns({"position": F.row_number().over(place), "n_teams": F.count(F.lit(1)).over(every)})
    return grid.filter("plays").select("match_id", "team", "position", "n_teams")


def final_table(sides: DataFrame) -> DataFrame:
    """(league, season, team, played, pts, gd, goals, position) after all matches."""
    table = sides.groupBy("league", "season", "team").agg(F.count(F.lit(1)).alias("played"), F.sum(_points()).alias("pts"), F.sum(F.col("gf") - F.col("ga")).alias("gd"), F.sum("gf").alias("goals"))
    place = Window.partitionBy("league", "season").orderBy(F.desc("pts"), F.desc("gd"), F.desc("goals"), "team")
    return table.withColumn("position", F.row_number().over(place))


def team_form(sides: DataFrame) -> DataFrame:
    """Form before each match: last five results, share of clean sheets, goals in the last eight, team match number."""
    w = Window.partitionBy("league", "season", "team").orderBy(*ORDER)
    five, eight = w.rowsBetween(-5, -1), w.rowsBetween(-8, -1)
    count = lambda x: F.coalesce(F.sum(F.when(_points() == x, 1).otherwise(0)).over(five), F.lit(0))
    return sides.select(
        "match_id", "team",
        F.count(F.lit(1)).over(five).alias("n5"), count(3).alias("won"), count(1).alias("drawn"), count(0).alias("lost"),
        F.avg(F.when(F.col("ga") == 0, 1.0).otherwise(0.0)).over(five).alias("clean_share"),
        F.avg("gf").over(eight).alias("mean_for"), F.avg("ga").over(eight).alias("mean_against"),
        (F.row_number().over(w) - 1).alias("team_no"),
    )


def points_per_game(sides: DataFrame) -> DataFrame:
    return sides.select("match_id", "team", F.avg(_points()).over(_before("league", "season", "team")).alias("ppg"))


def last_matches(sides: DataFrame, n: int = 5) -> DataFrame:
    """A team's last ``n`` matches, oldest first, with result letters."""
    latest = Window.partitionBy("team").orderBy(F.desc("dt"), F.desc("match_id"))
    rows = sides.withColumn("back", F.row_number().over(latest)).filter(F.col("back") <= n)
    again = Window.partitionBy("team").orderBy(*ORDER)
    result = F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") == F.col("ga"), "D").otherwise("L")
    return rows.select("team", F.row_number().over(again).alias("pos"), "match_id", "opp", "is_home", "gf", "ga", result.alias("result"))


def season_to_date(apps: DataFrame, *kept: str, within: tuple[str, ...] = ()) -> DataFrame:
    """A player's totals in his league season before each row, beside the columns ``kept``; only rows played count.  Sums of ratings where rows have them.

    ``within``: columns of which a player has one value in a season, if rows are dealt by them.
    """
    before = _before("player_id", "league", "season", *within)
    total = lambda c: F.coalesce(F.sum(F.when(F.col("minutes") > 0, c)).over(before), F.lit(0))
    rated = [] if "rating" not in apps.columns else [
        total(F.col("rating").isNotNull().cast("int")).alias("c_rated"), F.coalesce(total(F.coalesce("rating", F.lit(0.0))), F.lit(0.0)).alias("c_rating_sum"),
    ]
    return apps.select("match_id", "player_id", total(F.lit(1)).alias("c_apps"), *rated, total(F.col("minutes")).alias("c_min"), *kept)


def season_totals(apps: DataFrame) -> DataFrame:
    """(player_id, league, season) totals of rows played; rows without a rating may tell which are ``rated``."""
    rated = [F.count("rating").alias("rated"), F.coalesce(F.sum("rating"), F.lit(0.0)).alias("rating_sum")] if "rating" in apps.columns else [F.count("rated").alias("rated")]
    return apps.filter("minutes > 0").groupBy("player_id", "league", "season").agg(F.count(F.lit(1)).alias("apps"), *rated, F.sum("minutes").alias("min"))


def prior_season(apps: DataFrame, totals: DataFrame) -> DataFrame:
    """Each row's totals of the season before in the same league; null where there are none."""
    prior = totals.select("player_id", "league", (F.col("season") + 1).alias("season"), *(F.col(c).alias(f"p_{c}") for c in ("apps", "rated", "rating_sum", "min") if c in totals.columns))
    return apps.join(prior, ["player_id", "league", "season"], "left")


def squad_history(apps: DataFrame, numbers: DataFrame | None = None, *kept: str, within: tuple[str, ...] = ()) -> DataFrame:
    """A player's rows in the last five and ten team matches before each row, by the team's match number, beside the columns ``kept``.

    Without ``numbers`` (match_id, team, team_no), rows have their team_no; without ratings, no means of them are told.

    A player of one team has at most ten rows in ten numbers, so ten rows before
    are enough.  A transfer may bring a row of a later number earlier in time,
    so a player of several teams looks back over all his rows of the season.

    ``within``: columns of which a player has one value in a season, if rows are dealt by
    them.  With his team among them he has one, so his rows are in order of its numbers.
    """
    keys, one = ("player_id", "league", "season", *within), "team" in within
    by = ["team_no"] if one else ORDER
    rows = apps if numbers is None else apps.join(numbers.select("match_id", "team", "team_no"), ["match_id", "team"])
    order = Window.partitionBy(*keys).orderBy(*by)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    means = []
    if "rating" in rows.columns:
        # means of the last rated rows are windows over rated rows alone, carried forward to the next row
        rated = F.col("rating").isNotNull() & (F.col("minutes") > 30)
        rows = rows.withColumn("rated", F.coalesce(rated, F.lit(False)))
        own = Window.partitionBy(*keys, "rated").orderBy(*by)
        mean = lambda n: F.when(F.col("rated"), F.avg("rating").over(own.rowsBetween(1 - n, 0)))
        rows = rows.withColumns({"mean5": mean(5), "mean3": mean(3)})
        rows = rows.withColumns({"rating5": F.last("mean5", ignorenulls=True).over(before), "rating3": F.last("mean3", ignorenulls=True).over(before)})
        means = ["rating5", "rating3"]
    rows = rows.withColumn("gap", (F.col("team_no") - F.lag("team_no").over(order)).cast("long"))
    if one:
        sums = lambda n: {c: F.coalesce(F.sum(c).over(order.rangeBetween(-n, -1)), F.lit(0)).cast("long") for c in ("started", "minutes")}
        five, ten = sums(5), sums(10)
        squad5 = F.count(F.lit(1)).over(order.rangeBetween(-5, -1))
        return rows.select("match_id", "player_id", five["started"].alias("starts5"), five["minutes"].alias("min5"), squad5.alias("squad5"), ten["started"].alias("starts10"), ten["minutes"].alias("min10"), *means, "gap", *kept)
    every = Window.partitionBy(*keys)
    rows = rows.withColumn("moved", F.min("team").over(every) != F.max("team").over(every))
    row = F.struct("team_no", "started", "minutes")
    past = rows.filter(~F.col("moved")).withColumn("past", F.collect_list(row).over(order.rowsBetween(-10, -1)))
    past = past.unionByName(rows.filter("moved").withColumn("past", F.collect_list(row).over(before)))
    near = lambda n: F.filter("past", lambda x: (x["team_no"] >= F.col("team_no") - n) & (x["team_no"] < F.col("team_no")))
    add = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + f(x))
    return past.select(
        "match_id", "player_id",
        add(near(5), lambda x: x["started"]).alias("starts5"), add(near(5), lambda x: x["minutes"]).alias("min5"), F.size(near(5)).cast("long").alias("squad5"),
        add(near(10), lambda x: x["started"]).alias("starts10"), add(near(10), lambda x: x["minutes"]).alias("min10"), *means, "gap", *kept,
    )


def tail(xs: Column, n: int) -> Column:
    """The last ``n`` of a list, or all of a shorter one."""
    return F.slice(xs, F.greatest(F.lit(1), F.size(xs) - (n - 1)), F.lit(n))


def tail_mean(xs: Column, n: int) -> Column:
    t = tail(xs, n)
    return F.try_divide(F.aggregate(t, F.lit(0.0), lambda a, x: a + x), F.size(t).cast("double"))


def absent_rows(apps: DataFrame, numbers: DataFrame, reach: int = 10) -> DataFrame:
    """(match_id, team, player_id): not in a squad of his team, but in one of its last ``reach`` of the season, and not seen for another team since.

    A player's stints are gaps between his team's match numbers; each opens the
    numbers after it, up to his next one, the reach, or his first match for
    another team.
    """
    keys = ["league", "season"]
    rows = apps.join(numbers.select("match_id", "team", "team_no"), ["match_id", "team"])
    own = Window.partitionBy(*keys, "team", "player_id").orderBy("team_no")
    moves = Window.partitionBy(*keys, "player_id").orderBy(*ORDER)
    # rows of one team in a row are a spell; the row after it, for another team, ends its stints
    rows = rows.withColumn("_moved", (F.col("team") != F.lag("team").over(moves)).cast("int")).withColumn("_next", F.lead(F.struct("dt", "match_id")).over(moves))
    rows = rows.withColumn("_spell", F.coalesce(F.sum("_moved").over(moves), F.lit(0)))
    spell = Window.partitionBy(*keys, "player_id", "_spell").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    elsewhere = F.last("_next").over(spell)
    rows = rows.withColumn("next_no", F.lead("team_no").over(own)).withColumn("left_at", elsewhere)
    rows = rows.withColumn("until", F.least(F.coalesce(F.col("next_no") - 1, F.lit(1 << 30)), F.col("team_no") + reach))
    opened = rows.filter("until > team_no").select(*keys, "team", "player_id", "left_at", F.explode(F.sequence(F.col("team_no") + 1, F.col("until"))).alias("team_no"))
    games = numbers.select(*keys, "team", "team_no", "match_id", "dt")
    missing = opened.join(games, [*keys, "team", "team_no"])
    return missing.filter(F.col("left_at").isNull() | (F.struct("dt", "match_id") <= F.col("left_at"))).select("match_id", "team", "player_id")


def next_fixtures(sides: DataFrame, as_of: str, season: int, n: int = 1) -> DataFrame:
    """A team's next ``n`` matches from ``as_of`` on: those of the current round (here, season) first, then by date."""
    tier = F.when(F.col("season") == season, 0).otherwise(1)
    w = Window.partitionBy("team").orderBy(tier, *ORDER)
    ahead = sides.filter(F.col("dt") >= F.lit(as_of).cast("timestamp_ntz"))
    return ahead.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= n).select("team", "no", "match_id", "opp", "is_home")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_five(apps: DataFrame) -> DataFrame:
    """Adds a player's matches, starts and minutes in the five matches before: n5, s5, m5."""
    before = Window.partitionBy("player_id").orderBy(*ORDER).rowsBetween(-5, -1)
    return apps.withColumns({"n5": F.count(F.lit(1)).over(before), "s5": F.coalesce(F.sum("started").over(before), F.lit(0)), "m5": F.coalesce(F.sum("minutes").over(before), F.lit(0))})


def weighted_means(rows: DataFrame, keys: list[str], alpha: float, *values: str) -> DataFrame:
    """Exponentially weighted means of each key's values in match order, as plain weighted sums; the first value starts them."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"_i": F.row_number().over(w.orderBy(*ORDER)), "_n": F.count(F.lit(1)).over(w)})
    weight = F.when(F.col("_i") == 1, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), F.col("_n") - F.col("_i"))
    return rows.groupBy(*keys).agg(*(F.sum(weight * F.col(v)).alias(v) for v in values))


#: The position that a feed's usual line stands for.
USUAL = {0: "GK", 1: "CB", 2: "CM", 3: "ST"}


def native_positions(apps: DataFrame, native: DataFrame, weight: str | None = None) -> DataFrame:
    """(player_id, pos, known): a known position; else the one that most starters of the player's usual slot have; else by the usual line; else CM.

    apps: (player_id, started, slot, usual[, weight]); native: (player_id, native).  A row counts
    as many times as its weight.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    most = lambda rows, key, value: rows.groupBy(key, value).agg(n.alias("n")).groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("o"), value))[value].alias(value))
    starts = apps.filter("started = 1")
    proxy = most(starts.join(native, "player_id"), "slot", "native").withColumnRenamed("native", "proxy")
    usual = most(apps.filter("usual is not null"), "player_id", "usual")
    players = apps.select("player_id").distinct().join(native, "player_id", "left").join(most(starts, "player_id", "slot"), "player_id", "left").join(F.broadcast(proxy), "slot", "left").join(usual, "player_id", "left")
    return players.select("player_id", F.coalesce("native", "proxy", rules.lookup(F.col("usual"), USUAL), F.lit("CM")).alias("pos"), F.col("native").isNotNull().alias("known"))
