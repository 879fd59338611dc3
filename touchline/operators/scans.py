"""Scans: what a sequence has made of a state before each of its rows, a sequence in many tasks.

Each row maps the state, and maps of a kind compose to maps of that kind.  Rows
are dealt by ranges of (keys, order) and kept there once, so both passes see the
same.  A range shares with the one before it at most its first key, so the first
pass gives one row for each range: its first and last key, and the composed map
of the last key's rows.  The driver goes through these (as many as there are
tasks, whatever the rows), and the second pass takes each range from the state it
begins with.

Of rows with equal keys and order it isn't said which comes first, so the order
should be unique within a key.  Null keys and orders come first, as in a sort.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.sources.landing import keep


@dataclass(frozen=True)
class Mean:
    """Exponential mean of ``value``: the first value, then x + alpha * (value - x); null before the first."""

    value: str
    alpha: float
    start = None
    kind = "double"

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.value,)

    def read(self, x: float | None, value: float) -> float | None:
        return x

    def step(self, x: float | None, value: float) -> float:
        return value if x is None else x + self.alpha * (value - x)

    def compose(self, rows: list[tuple]) -> list[float]:
        """[a, b, c]: after the rows the state is a * x + b, or c where there was none."""
        left, a, b, c = 1 - self.alpha, 1.0, 0.0, None
        for (v,) in rows:
            a, b, c = left * a, left * b + self.alpha * v, self.step(c, v)
        return [a, b, c]

    def apply(self, x: float | None, maps: list[float]) -> float:
        return maps[2] if x is None else maps[0] * x + maps[1]


@dataclass(frozen=True)
class Affine:
    """x -> a * x + b, with columns ``a`` and ``b``, from ``start``."""

    a: str
    b: str
    start: float
    kind = "double"

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.a, self.b)

    def read(self, x: float, a: float, b: float) -> float:
        return x

    def step(self, x: float, a: float, b: float) -> float:
        return a * x + b

    def compose(self, rows: list[tuple]) -> list[float]:
        """[a, b] of all rows at once."""
        a, b = 1.0, 0.0
        for p, q in rows:
            a, b = p * a, p * b + q
        return [a, b]

    def apply(self, x: float, maps: list[float]) -> float:
        return maps[0] * x + maps[1]


@dataclass(frozen=True)
class Count:
    """Number of rows before; when ``mark`` changes, ``cap`` of them count at most.  The state is (number, last mark)."""

    mark: str
    cap: float = math.inf
    start = None
    kind = "long"

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.mark,)

    def read(self, x: tuple | None, mark) -> int:
        return 0 if x is None else int(min(x[0], self.cap)) if mark != x[1] else x[0]

    def step(self, x: tuple | None, mark) -> tuple:
        return self.read(x, mark) + 1, mark

    def compose(self, rows: list[tuple]) -> list[float]:
        """[first mark, last mark, cap, added]: min(n, cap) + added, n being capped before that if the first mark is new."""
        first = last = rows[0][0]
        cap, added = math.inf, 0
        for (mark,) in rows:
            if mark != last:
                cap, last = min(cap, self.cap - added), mark
            added += 1
        return [first, last, cap, added]

    def apply(self, x: tuple | None, maps: list[float]) -> tuple:
        first, last, cap, added = maps
        return int(min(self.read(x, first), cap) + added), last


Kind = Mean | Affine | Count


def _rows(batch: pd.DataFrame, names: tuple[str, ...]) -> list[tuple]:
    columns = [[None if v is pd.NaT or v != v else v for v in batch[c].tolist()] for c in names]
    return list(zip(*columns, strict=True))


def before(rows: DataFrame, keys: list[str], order: list[str], kinds: dict[str, Kind], ranges: int | None = None) -> DataFrame:
    """Adds a column for each kind: its state before the row, within ``keys`` by ``order``."""
    by = [F.col(c) for c in (*keys, *order)]
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    dealt = keep(dealt.withColumn("range", F.spark_partition_id()).sortWithinPartitions(*by))
    needed = list(dict.fromkeys(["range", *keys, *(c for k in kinds.values() for c in k.columns)]))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = number = None
        maps: dict[str, object] = {}
        for batch in batches:
            if batch.empty:
                continue
            number = int(batch["range"].iloc[0])
            key = _rows(batch, tuple(keys))
            first = key[0] if first is None else first
            lo = len(key) - 1
            while lo and key[lo - 1] == key[-1]:
                lo -= 1
            for name, kind in kinds.items():
                own = kind.compose(_rows(batch.iloc[lo:], kind.columns))
                maps[name] = (*maps[name], own) if lo == 0 and last == key[-1] else (own,)
            last = key[-1]
        if number is not None:
            yield pd.DataFrame({"range": [number], "told": [pickle.dumps((first, last, maps))]})

    told = {r.range: pickle.loads(r.told) for r in dealt.select(*needed).mapInPandas(summed, "range int, told binary").collect()}  # one row for each task
    begin: dict[int, dict[str, object]] = {}
    key, states = None, {}
    for number in sorted(told):
        first, last, maps = told[number]
        begin[number] = states if first == key else {}
        own = begin[number] if first == last else {}
        states = {}
        for name, kind in kinds.items():
            x = own.get(name, kind.start)
            for m in maps[name]:
                x = kind.apply(x, m)
            states[name] = x
        key = last

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, states = None, {}
        for batch in batches:
            if batch.empty:
                continue
            own = _rows(batch, tuple(keys))
            if key is None:
                key, states = own[0], dict(begin.get(int(batch["range"].iloc[0]), {}))
            out: dict[str, list] = {}
            for name, kind in kinds.items():
                at, x, seen = key, states.get(name, kind.start), []
                for k, values in zip(own, _rows(batch, kind.columns), strict=True):
                    if k != at:
                        at, x = k, kind.start
                    seen.append(kind.read(x, *values))
                    x = kind.step(x, *values)
                out[name], states[name] = seen, x
            key = own[-1]
            yield batch.drop(columns="range").assign(**{n: pd.Series(v, index=batch.index, dtype="Int64" if kinds[n].kind == "long" else "float64") for n, v in out.items()})

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return dealt.mapInPandas(taken, ", ".join([*kept, *(f"`{n}` {k.kind}" for n, k in kinds.items())]))

