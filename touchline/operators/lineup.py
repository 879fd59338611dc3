"""Line-ups under formation slots, position malus and the defence bonus.

A squad becomes one row of arrays.  Tasks search many squads at once in numpy:
what a player is worth in a slot is a table of squads, slots and players, and a
move's gain is a difference of its entries and of the bonus.  The best formation
of a squad is a window over its scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline import dims

POSITIONS = list(dims.POSITION_GROUP)
_AT_ONCE, _ROUNDS, _LEAST = 256, 50, 1e-9


def _malus_table(slots: list[list[str]]) -> np.ndarray:
    """Slots x positions: the best malus over what a slot takes; -inf where nothing fits."""
    out = np.full((len(slots), len(POSITIONS)), -np.inf)
    for i, slot in enumerate(slots):
        for taken in slot:
            for p, m in dims.MALUS[taken].items():
                j = POSITIONS.index(p)
                out[i, j] = max(out[i, j], m)
    return out


def bonus_points(mean: np.ndarray) -> np.ndarray:
    return np.where(mean < 7, 0, np.minimum(5, np.floor((mean - 7) / 0.25 + 1e-9) + 1))


class Squads:
    """Some squads in one formation.

    ``plays``: squads x players x positions; ``keeper``: whose first position is
    the goal; ``total``, ``base``, ``start``: squads x players (absent ones have
    no positions).  ``best(...)`` gives (feasible, keeper, team, score, bonus).
    """

    def __init__(self, plays: np.ndarray, keeper: np.ndarray, total: np.ndarray, base: np.ndarray, start: np.ndarray, slots: list[list[str]]):
        table = _malus_table(slots)
        self.malus = np.where(plays[:, None], table[None, :, None], -np.inf).max(axis=3)  # squads x slots x players
        self.malus[np.broadcast_to(keeper[:, None], self.malus.shape)] = -np.inf
        self.fits = np.isfinite(self.malus)
        worth = np.maximum(0, total[:, None] + np.where(self.fits, self.malus, 0) * dims.UNITS_PER_POINT * start[:, None])
        self.worth = np.where(self.fits, np.where(self.malus == 0, total[:, None], worth), -np.inf)
        self.keeper, self.total, self.base = keeper, total, base
        self.back = np.array([set(s) <= set(dims.BACK_LINE) for s in slots])
        self.one = np.arange(len(total))

    def bonus(self, base_sum: np.ndarray) -> np.ndarray:
        return bonus_points(base_sum / self.back.sum()) if self.back.any() else np.zeros_like(base_sum)

    def fill(self) -> tuple[np.ndarray, np.ndarray]:
        """(feasible, team): slot after slot, the scarcest first, by natives and then by all who fit.

        A slot takes its native of highest total, or without one the player worth most there.
        """
        squads, slots, _ = self.fits.shape
        team, free, can = np.full((squads, slots), -1), ~self.keeper, np.ones(squads, bool)
        for _ in range(slots):
            fits = self.fits & free[:, None]
            native = fits & (self.malus == 0)
            left, own = fits.sum(axis=2), native.sum(axis=2)
            can &= ((left > 0) | (team >= 0)).all(axis=1)
            scarce = np.where(team >= 0, np.iinfo(np.int64).max, own * 10_000 + left)
            i = scarce.argmin(axis=1)
            by_total, by_worth = np.where(native[self.one, i], self.total, -np.inf), np.where(fits[self.one, i], self.worth[self.one, i], -np.inf)
            pick = np.where(own[self.one, i] > 0, by_total.argmax(axis=1), by_worth.argmax(axis=1))
            team[self.one, i] = pick
            free[self.one, pick] = False
        return can, team

    def gains(self, team: np.ndarray) -> np.ndarray:
        """Squads x slots x (players, then slots): the gain of each replacement, and of each swap with a later slot."""
        own, slot = self.one[:, None], np.arange(team.shape[1])
        now, base = self.worth[own, slot, team], self.base[own, team]
        total = (base * self.back).sum(axis=1)
        had = self.bonus(total)[:, None, None]
        used = np.zeros(self.total.shape, bool)
        used[own, team] = True
        replaced = self.worth - now[:, :, None]
        lift = self.back[None, :, None] * (self.base[:, None] - base[:, :, None])
        replaced = replaced + dims.UNITS_PER_POINT * (self.bonus(total[:, None, None] + lift) - had)
        replaced[np.broadcast_to(used[:, None], replaced.shape)] = -np.inf
        across = self.worth[self.one[:, None, None], slot[None, :, None], team[:, None, :]]  # worth in slot i of who plays in slot j
        swapped = across + across.transpose(0, 2, 1) - now[:, :, None] - now[:, None]
        lift = (self.back[:, None] * 1 - self.back[None] * 1) * (base[:, None] - base[:, :, None])
        swapped = swapped + dims.UNITS_PER_POINT * (self.bonus(total[:, None, None] + lift) - had)
        swapped[:, slot[:, None] >= slot] = -np.inf
        return np.concatenate([replaced, swapped], axis=2)

    def climb(self, team: np.ndarray) -> np.ndarray:
        """The best of all moves, again and again while one gains."""
        team, players = team.copy(), self.total.shape[1]
        for _ in range(_ROUNDS):
            gains = self.gains(team)
            flat = gains.reshape(len(team), -1)
            move = flat.argmax(axis=1)
            go = np.flatnonzero(flat[self.one, move] > _LEAST)
            if not len(go):
                break
            i, to = np.divmod(move[go], gains.shape[2])
            other = to >= players
            was = team[go, i]
            team[go, i] = np.where(other, team[go, np.maximum(0, to - players)], to)
            team[go[other], to[other] - players] = was[other]
        return team

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        can, team = self.fill()
        can &= self.keeper.any(axis=1)
        with np.errstate(invalid="ignore"):  # squads that can't fill the formation have no worth to compare
            team = self.climb(team)
        goal = np.where(self.keeper, self.total, -np.inf).argmax(axis=1)
        bonus = self.bonus((self.base[self.one[:, None], team] * self.back).sum(axis=1))
        score = self.total[self.one, goal] + self.worth[self.one[:, None], np.arange(team.shape[1]), team].sum(axis=1) + bonus * dims.UNITS_PER_POINT
        return can, goal, team, score, bonus


_OUT = "squad_id long, formation string, formation_no int, score double, bonus int, ids array<long>, malus array<double>"


def search(squads: DataFrame, formations: list[str] | None, found, out: str) -> DataFrame:
    """Rows ``out`` that ``found(number, formation, squad ids, player ids, Squads)`` gives of many squads at once, for each formation.

    ``squads``: (squad_id, k, player_id, positions, total, base_rating, start_prob); k is the order of ties.
    """
    every = list(dims.SLOTS)
    slots = {f: (every.index(f), dims.SLOTS[f]) for f in (every if formations is None else formations)}
    player = F.struct("k", F.col("player_id").cast("long").alias("id"), "positions", F.col("total").cast("double").alias("total"), F.col("base_rating").cast("double").alias("base"), F.col("start_prob").cast("double").alias("start"))
    rows = squads.groupBy(F.col("squad_id").cast("long").alias("squad_id")).agg(F.sort_array(F.collect_list(player)).alias("p"))  # a squad's few players
    rows = rows.select("squad_id", *(F.col(f"p.{c}").alias(c) for c in ("id", "positions", "total", "base", "start")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _AT_ONCE):
                squad, ids, positions, *numbers = (c.to_pylist() for c in batch.slice(lo, _AT_ONCE).columns)
                width = max(map(len, ids))
                total, base, start = (np.array([x + [0.0] * (width - len(x)) for x in c]) for c in numbers)
                plays, keeper = np.zeros((len(ids), width, len(POSITIONS)), bool), np.zeros((len(ids), width), bool)
                for s, players in enumerate(positions):
                    for p, own in enumerate(players):
                        plays[s, p, [POSITIONS.index(x) for x in own if x in POSITIONS]] = True
                        keeper[s, p] = bool(own) and own[0] == "GK"
                for name, (number, own_slots) in slots.items():
                    told = list(found(number, name, squad, ids, Squads(plays, keeper, total, base, start, own_slots)))
                    columns = list(zip(*told, strict=True)) or [[]] * len(schema)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in out.split(", ")])
    return rows.mapInArrow(run, out)


def _climbed(number: int, name: str, squad: list, ids: list, group: Squads) -> Iterator[tuple]:
    can, goal, team, score, bonus = group.best()
    for s in np.flatnonzero(can).tolist():
        malus = [0.0, *group.malus[s, np.arange(team.shape[1]), team[s]].tolist()]
        yield squad[s], name, number, float(score[s]), int(bonus[s]), [ids[s][goal[s]], *(ids[s][p] for p in team[s])], malus


def formation_lineups(squads: DataFrame, formations: list[str] | None = None) -> DataFrame:
    """The climbed line-up of every squad in every formation it can fill."""
    return search(squads, formations, _climbed, _OUT)


def best_lineups(lineups: DataFrame) -> DataFrame:
    """A squad's formation of highest score, the first of equals."""
    w = Window.partitionBy("squad_id").orderBy(F.desc("score"), "formation_no")
    return lineups.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def slot_fits(squads: DataFrame) -> DataFrame:
    """(squad_id, formation, slot_no, player_id, malus): every player's best malus in every slot he fits."""
    spark = squads.sparkSession
    slots = spark.createDataFrame([(f, i, p) for f, ss in dims.SLOTS.items() for i, s in enumerate(ss) for p in s], "formation string, slot_no int, slot_pos string")
    malus = spark.createDataFrame([(s, p, m) for s, row in dims.MALUS.items() for p, m in row.items()], "slot_pos string, pos string, malus double")
    # both dimensions are fixed tables of a few hundred rows, and so are the best of each position
    fits = slots.join(malus, "slot_pos").groupBy("pos", "formation", "slot_no").agg(F.max("malus").alias("malus"))
    fits = fits.groupBy("formation", "slot_no").agg(F.map_from_entries(F.collect_list(F.struct("pos", "malus"))).alias("by_pos"))
    fits = F.broadcast(fits.agg(F.collect_list(F.struct("formation", "slot_no", "by_pos")).alias("slots")))
    # players are grouped, not their slots, which are many times as many
    rows = squads.groupBy("squad_id", "player_id").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"))
    rows = rows.crossJoin(fits).select("squad_id", "player_id", "positions", F.inline("slots"))
    best = F.array_max(F.transform("positions", lambda p: F.try_element_at("by_pos", p)))
    return rows.select("squad_id", "formation", "slot_no", "player_id", best.alias("malus")).filter("malus is not null")
