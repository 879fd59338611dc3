"""Ratings kept as keyed state under Structured Streaming, and windows of cards.

State is Spark's own, by league, in the query's checkpoint: the table of teams,
the league's mean, and the ids of matches taken in, whatever their month.  A match
whose id was taken in before changes nothing, be it sent again with another date
or without one.  A restart goes on from the checkpoint, and ``kept`` reads the
table from it at any time, with or without the query.

Matches that come late (dated before one already taken in) have two readings:

``append``  a late match moves the ratings when it comes, after later matches.
``rewind``  the league goes back to the state before the month of the late match
            and takes that month and all after it again, so the ratings equal a
            replay of all matches in order.  For this a league also keeps its
            matches and a copy of the table by month.

Matches without a date are a month of their own before all others, as in a
replay; those without an id, a score or a team are left out.  Of rows with one id
in a batch the first by date counts.  Leagues run side by side; a league's batch
is one task, as each match reads what the last one left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from touchline.operators import ratings

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAMES = [c.split()[0] for c in ratings.STATE.split(", ")]
_TEAM = "elo double, att double, dfn double, n int, season int"
_UNDATED = ""
#: Ids that are equal but for this many low bits are kept under one key.
_NEAR = 12


class LeagueRatings(StatefulProcessor):
    """One league's ratings; gives its table after each batch that moved it."""

    def __init__(self, rewind: bool):
        self.rewind = rewind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.teams = handle.getMapState("teams", "team long", _TEAM)
        self.mean = handle.getValueState("mean", "mu double, mu_n int")
        # Ids by neighbours, two bytes each: a call for each id would cost more than its match's step.
        self.taken = handle.getMapState("taken", "near long", "ids binary")
        # A month's matches and the table before them, as JSON, which keeps doubles as they are.
        self.months = handle.getMapState("months", "month string", "matches string, before string") if self.rewind else None

    def _table(self) -> ratings.Table:
        if not self.mean.exists():
            return ratings.Table()
        mu, mu_n = self.mean.get()
        table = ratings.Table(mu=mu, mu_n=mu_n)
        for (team,), own in self.teams.iterator():
            table.load(team, *own, mu, mu_n)
        return table

    def _keep(self, table: ratings.Table) -> None:
        for team, own in table.teams.items():
            self.teams.updateValue((team,), tuple(own))
        self.mean.update((table.mu, table.mu_n))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        table = ratings.Table()
        for row in initialState[["team", *ratings.TEAM, "mu", "mu_n"]].itertuples(index=False):
            table.load(*row)
        self._keep(table)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["dt", "match_id"], na_position="first").drop_duplicates("match_id")
        new: dict[str, list[list]] = {}
        for match, dt, *step in batch.loc[self._fresh(batch["match_id"].to_numpy(np.int64)), ["match_id", "dt", *ratings.STEP]].itertuples(index=False):
            month = _UNDATED if pd.isna(dt) else f"{dt:%Y-%m}"
            new.setdefault(month, []).append([_UNDATED if pd.isna(dt) else dt.isoformat(), match, *step])
        if not new:
            return
        table = self._table()
        if self.rewind:
            table = self._rewound(table, new)
        else:
            for month in sorted(new):
                _take(table, new[month])
        self._keep(table)
        out = pd.DataFrame(table.rows(key[0]), columns=_NAMES)
        yield out.astype({"att": float, "dfn": float})

    def _fresh(self, ids: np.ndarray) -> np.ndarray:
        """Which of distinct ids weren't taken in before; now they are."""
        near, own = ids >> _NEAR, (ids & ((1 << _NEAR) - 1)).astype("<u2")
        fresh, order = np.zeros(len(ids), bool), np.argsort(near, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
            key = (int(near[at[0]]),)
            had = np.frombuffer(self.taken.getValue(key)[0], "<u2") if self.taken.containsKey(key) else own[:0]
            fresh[at] = ~np.isin(own[at], had)
            if fresh[at].any():
                self.taken.updateValue(key, (np.concatenate([had, own[at][fresh[at]]]).tobytes(),))
        return fresh

    def _rewound(self, table: ratings.Table, new: dict[str, list[list]]) -> ratings.Table:
        """The table after going back to the first new month and taking all from there on again."""
        first = min(new)
        later = sorted(m for (m,) in self.months.keys() if m >= first)
        if later:
            table = _table_of(self.months.getValue((later[0],))[1])
        for month in sorted({*later, *new}):
            matches = json.loads(self.months.getValue((month,))[0]) if month in later else []
            matches = sorted(matches + new.get(month, []), key=lambda m: m[:2])
            self.months.updateValue((month,), (json.dumps(matches), _text_of(table)))
            _take(table, matches)
        return table

    def close(self) -> None:
        pass


def _take(table: ratings.Table, matches: list[list]) -> None:
    for _, _, *step in matches:
        table.step(*step)


def _text_of(table: ratings.Table) -> str:
    return json.dumps([table.mu, table.mu_n, [[k, *v] for k, v in table.teams.items()]])


def _table_of(text: str) -> ratings.Table:
    mu, mu_n, teams = json.loads(text)
    return ratings.Table({k: own for k, *own in teams}, mu, mu_n)


def rated(matches: DataFrame, late: str = "append", state: DataFrame | None = None) -> DataFrame:
    """A stream of league tables (as ``ratings.STATE``) after each batch of a stream of matches.

    ``state``: tables to begin with, as ``ratings.state_after`` gives them; a late
    match is never put before those.
    """
    if late not in ("append", "rewind"):
        raise ValueError(f"late matches are appended or rewound to, not {late!r}")
    matches.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = ratings.walkable(matches).filter("match_id is not null and league is not null").groupBy("league")
    begun = None if state is None else state.groupBy("league")
    return rows.transformWithStateInPandas(LeagueRatings(late == "rewind"), ratings.STATE, "update", "none", initialState=begun)


def keep_ratings(matches: DataFrame, checkpoint: str, late: str = "append", state: DataFrame | None = None, once: bool = False) -> StreamingQuery:
    """Start keeping ratings of a stream of matches; ``once``: take what is there and end."""
    out = rated(matches, late, state).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def kept(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The tables of all leagues in a checkpoint, as ``ratings.STATE``."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    teams = read("teams").select(F.col("key.league").alias("league"), F.col("user_map_key.team").alias("team"), "user_map_value.*")
    means = read("mean").select(F.col("key.league").alias("league"), "value.*")
    return teams.join(means, "league").select(*_NAMES)


def card_windows(cards: DataFrame, late: str = "1 day", length: str = "12 days", slide: str = "1 day") -> DataFrame:
    """Cards of a player in sliding windows, with a watermark for late events."""
    return (
        cards.withWatermark("ts", late)
        .groupBy(F.window("ts", length, slide), "player_id")
        .agg(F.count(F.lit(1)).alias("cards"), F.count_if(F.col("card") == "Yellow").alias("yellow"))
        .select("player_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "cards", "yellow")
    )
