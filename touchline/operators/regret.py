"""What line-ups brought: by the engine's scores and by hindsight, with an exact bound for the search.

A squad is searched in every formation twice, once by the scores it had before the
matches and once by what its players then brought.  Both line-ups are worth what
they realised.  Besides, ``bounds`` gives a value that no line-up of a formation
can exceed, which the hill climb is measured against.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import dims
from touchline.operators import lineup

_NEVER = 1e7
#: Steps of the search for a tier's price, and the largest price.
STEPS, PRICE = 12, 200.0


def hindsight_total(played: Column, points: Column) -> Column:
    """What a player's score would have been: his points over replacement in units; next to nothing if he didn't play."""
    least = F.lit(0.01)
    return F.when(played & points.isNotNull(), F.greatest(least, (points - dims.REPLACEMENT) * dims.UNITS_PER_POINT)).otherwise(least)


def assign(worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best sum, player of each slot) of many tables squads x slots x players, by the Hungarian method on all at once.

    -inf entries don't fit; a squad that can't fill all slots has the sum -inf.  Slots are added one
    after another along the cheapest alternating path, with the prices of slots and players kept.
    """
    cost = np.where(np.isfinite(worth), -worth, _NEVER)
    squads, slots, players = cost.shape
    one = np.arange(squads)
    u, v = np.zeros((squads, slots + 1)), np.zeros((squads, players + 1))
    holder = np.zeros((squads, players + 1), int)  # the slot that has a player, from 1; 0: nobody
    for slot in range(1, slots + 1):
        holder[:, 0] = slot
        at = np.zeros(squads, int)
        least, way = np.full((squads, players + 1), np.inf), np.zeros((squads, players + 1), int)
        used = np.zeros((squads, players + 1), bool)
        open_ = np.ones(squads, bool)
        while open_.any():
            go = np.flatnonzero(open_)
            used[go, at[go]] = True
            row = holder[go, at[go]]
            reduced = cost[go, row - 1] - u[go, row][:, None] - v[go, 1:]
            better = (reduced < least[go, 1:]) & ~used[go, 1:]
            least[go, 1:] = np.where(better, reduced, least[go, 1:])
            way[go, 1:] = np.where(better, at[go][:, None], way[go, 1:])
            free = np.where(used[go], np.inf, least[go])
            free[:, 0] = np.inf
            to = free.argmin(axis=1)
            delta = free[np.arange(len(go)), to]
            rows_, mine = np.nonzero(used[go])
            np.add.at(u, (go[rows_], holder[go[rows_], mine]), delta[rows_])
            v[go] -= delta[:, None] * used[go]
            least[go] = np.where(used[go], least[go], least[go] - delta[:, None])
            at[go] = to
            open_[go] = holder[go, to] != 0
        back = np.ones(squads, bool)
        while back.any():
            go = np.flatnonzero(back)
            before = way[go, at[go]]
            holder[go, at[go]] = holder[go, before]
            at[go] = before
            back[go] = before != 0
    team = np.full((squads, slots), -1)
    s, p = np.nonzero(holder[:, 1:])
    team[s, holder[s, p + 1] - 1] = p
    total = worth[one[:, None], np.arange(slots), team].sum(axis=1)
    return total, team


def tier_bound(group: lineup.Squads) -> np.ndarray:
    """For each squad a score that no team of the formation exceeds (without the keeper).

    A team has the bonus of one tier.  For a tier that asks for a mean of the back
    line, any price on what the line has over it gives a bound (the best
    assignment with the price added), and the lowest of these is taken.
    """
    least, team = assign(group.worth)
    if not group.back.any():
        return least
    mean = lambda at, need: np.where(group.back[None, :, None], group.base[at][:, None] - need, 0.0)
    has = lambda over, team: over[np.arange(len(over))[:, None], np.arange(team.shape[1]), team].sum(axis=1) >= 0
    needs = [7 + 0.25 * (tier - 1) - 1e-9 for tier in range(1, 6)]
    # where the best assignment has a tier by itself, no price gives a lower bound
    free = np.array([has(mean(group.one, need), team) for need in needs])
    out = np.where(free, least + np.arange(1, 6)[:, None] * dims.UNITS_PER_POINT, least).max(axis=0)  # or the tier without a bonus
    for tier, need in enumerate(needs, 1):
        low, high = np.zeros(len(out)), np.full(len(out), PRICE)
        best = least.copy()
        for _ in range(STEPS):
            # a tier whose bound is below another's already needs no lower one
            at = np.flatnonzero(~free[tier - 1] & (best + tier * dims.UNITS_PER_POINT > out))
            if not len(at):
                break
            price, over = (low[at] + high[at]) / 2, mean(at, need)
            total, team = assign(group.worth[at] + price[:, None, None] * over)
            best[at] = np.minimum(best[at], total)
            with np.errstate(invalid="ignore"):
                enough = has(over, team)
            low[at], high[at] = np.where(enough, low[at], price), np.where(enough, price, high[at])
        out = np.where(free[tier - 1], out, np.maximum(out, best + tier * dims.UNITS_PER_POINT))
    return out


def bounds(squads: DataFrame, formations: list[str] | None = None) -> DataFrame:
    """(squad_id, formation, score, bound): the climbed score, and one that no line-up exceeds."""
    return lineup.search(squads, formations, _bounded, "squad_id long, formation string, score double, bound double")


def _bounded(number: int, name: str, squad: list, ids: list, group: lineup.Squads) -> Iterator[tuple]:
    can, goal, _, score, _ = group.best()
    top = tier_bound(group) + group.total[group.one, goal]
    for s in np.flatnonzero(can).tolist():
        yield squad[s], name, float(score[s]), float(top[s])


def realised(lineups: DataFrame, results: DataFrame) -> DataFrame:
    """Adds ``points`` to line-ups (squad_id, formation, ids, malus): what they brought.

    ``results``: (squad_id, player_id, played, points, base): players who didn't
    play bring nothing; the others their points and malus; and the bonus is that of the back
    line's real ratings, 0 for those who didn't play.
    """
    spark = lineups.sparkSession
    back = {f: [i + 1 for i, s in enumerate(ss) if set(s) <= set(dims.BACK_LINE)] for f, ss in dims.SLOTS.items()}
    lines = spark.createDataFrame(list(back.items()), "formation string, back array<int>")
    rows = lineups.select("squad_id", "formation", F.posexplode("ids").alias("slot", "player_id"), "malus").join(results, ["squad_id", "player_id"]).join(F.broadcast(lines), "formation")
    own = F.col("played") & F.col("points").isNotNull()
    in_line = F.array_contains("back", F.col("slot"))
    rows = rows.groupBy("squad_id", "formation").agg(
        F.sum(F.when(own, F.col("points") + F.element_at("malus", F.col("slot") + 1)).otherwise(0.0)).alias("sum"),
        F.avg(F.when(in_line, F.when(F.col("played"), F.coalesce("base", F.lit(0.0))).otherwise(0.0))).alias("line"),
    )
    from touchline.functions import rules

    bonus = F.when(F.col("line").isNull(), 0.0).otherwise(rules.defence_bonus(F.coalesce("line", F.lit(0.0))))
    return lineups.join(rows.select("squad_id", "formation", (F.col("sum") + bonus).alias("points")), ["squad_id", "formation"])


def formation_regret(squads: DataFrame, results: DataFrame) -> DataFrame:
    """(squad_id, formation, formation_no, score, engine, hindsight): what both line-ups of each formation brought."""
    then = results.select("squad_id", "player_id", hindsight_total(F.col("played"), F.col("points")).alias("total"), F.coalesce("base", F.lit(6.0)).alias("base_rating"), F.lit(1.0).alias("start_prob"))
    known = squads.drop("total", "base_rating", "start_prob").join(then, ["squad_id", "player_id"])
    engine = realised(lineup.formation_lineups(squads), results).select("squad_id", "formation", "formation_no", "score", F.col("points").alias("engine"))
    hindsight = realised(lineup.formation_lineups(known), results).select("squad_id", "formation", F.col("points").alias("hindsight"))
    return engine.join(hindsight, ["squad_id", "formation"], "left")


def decompose(regret: DataFrame) -> DataFrame:
    """(squad_id, formation, engine, best_formation, best_players, both, mean_formation) of ``formation_regret``.

    ``engine``: the formation of the best score; ``best_formation``: the engine's line-up of the formation that
    brought most; ``best_players``: hindsight's line-up of the engine's formation; ``both``:
    the best of hindsight's.  Squads that fill no formation have no row.
    """
    picked = F.max(F.struct("score", (-F.col("formation_no")).alias("no"), "formation", "engine", "hindsight")).alias("p")
    means = regret.groupBy("squad_id").agg(picked, F.max("engine").alias("best_formation"), F.max("hindsight").alias("both"), F.avg("engine").alias("mean_formation"))
    return means.select("squad_id", "p.formation", "p.engine", "best_formation", F.col("p.hindsight").alias("best_players"), "both", "mean_formation")


def regret_means(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of a decomposition (for each ``by``), and how far the engine's formation beats an average one, with a half-width."""
    names = ["engine", "mean_formation", "best_formation", "best_players", "both"]
    over = F.col("engine") - F.col("mean_formation")
    n = F.count(F.lit(1))
    return rows.groupBy(*(by or [])).agg(n.alias("n"), *(F.avg(c).alias(c) for c in names), F.avg(over).alias("pick_gain"), (1.96 * F.stddev_samp(over) / F.sqrt(n)).alias("pick_half_width"))
