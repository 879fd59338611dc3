"""A data source of landed documents: ``spark.read.format("landed")``.

A folder holds a folder for each collection, and in it files of JSON lines, each
``{"key": ..., "cached_at": milliseconds, "doc": {...}}``, or files ``<key>.json``
of one document.  Rows are (collection, key, cached_at, doc, file): ``doc`` is the
document's JSON text, which the functions of ``sources.feeds`` parse.

Options: ``path``, ``collections`` (comma-separated; all if not given), and
``partition_bytes`` (files of about so many bytes make one partition; a file is
never split).  Filters on ``collection`` leave folders out, and on ``key`` leave
out files of one document, before anything is read; both are applied to lines
too, so Spark doesn't apply them again.  A line that isn't JSON gives a row with a
null key and the line as ``doc``, so nothing is lost in silence.  Files and
folders whose names begin with ``_`` or ``.`` are not data.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from touchline.sources import feeds

SCHEMA = "collection string, key string, cached_at long, doc string, file string"
PARTITION_BYTES = 32 << 20


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


@dataclass
class Files(InputPartition):
    """Files (collection, path) that one task reads."""

    files: list[tuple[str, str]]


class LandedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("the landed source needs a path")
        told = options.get("collections")
        self.collections = {c.strip() for c in told.split(",")} if told else None
        self.keys: set[str] | None = None
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equalities and lists on collection and key; gives the others back."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("collection",), ("key",)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = "collections" if f.attribute == ("collection",) else "keys"
                had = getattr(self, name)
                setattr(self, name, wanted if had is None else had & wanted)
            else:
                yield f

    def partitions(self) -> Sequence[Files]:
        store, root = _store(self.path)
        out: list[Files] = []
        size = self.size
        for folder in sorted(store.get_file_info(pafs.FileSelector(root)), key=lambda x: x.base_name):
            name = folder.base_name
            if folder.type != pafs.FileType.Directory or name[0] in "._" or (self.collections is not None and name not in self.collections):
                continue
            for file in sorted(store.get_file_info(pafs.FileSelector(folder.path, recursive=True)), key=lambda x: x.path):
                if file.type != pafs.FileType.File or file.base_name[0] in "._" or (self.keys is not None and _single(file.path) and _key(file.path) not in self.keys):
                    continue
                if not out or size + file.size > self.size:
                    out.append(Files([]))
                    size = 0
                out[-1].files.append((name, file.path))
                size += file.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for collection, path in partition.files:
            with store.open_input_stream(path) as f:
                if _single(path):
                    yield collection, _key(path), None, f.read().decode("utf-8", "replace"), path
                    continue
                rest = b""
                while chunk := f.read(1 << 20):
                    *lines, rest = (rest + chunk).split(b"\n")
                    yield from self._rows(collection, path, lines)
                yield from self._rows(collection, path, [rest])

    def _rows(self, collection: str, path: str, lines: list[bytes]) -> Iterator[tuple]:
        for line in lines:
            if not line.strip():
                continue
            try:
                row = json.loads(line)
                key, at, doc = str(row["key"]), row.get("cached_at"), json.dumps(row["doc"], ensure_ascii=False)
                at = None if at is None else int(at)
            except (ValueError, KeyError, TypeError, AttributeError):
                key, at, doc = None, None, line.decode("utf-8", "replace")
            if self.keys is None or key in self.keys:
                yield collection, key, at, doc, path


def _single(path: str) -> bool:
    return path.endswith(".json")


def _key(path: str) -> str:
    return posixpath.basename(path).removesuffix(".json")


class LandedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)


_LEAGUE, _MATCH, _TEAM, _PLAYER = ("league", "bigint"), ("match_id", "bigint"), ("team", "bigint"), ("player_id", "bigint")
#: Feeds by name: the columns that a parser carries (a key's parts, between slashes), and the parser.
FEEDS = {
    "league_matches": ((_LEAGUE,), feeds.league_matches), "current_round": ((_LEAGUE,), feeds.current_round), "table_rows": ((_LEAGUE,), feeds.table_rows), "seasons": ((_LEAGUE,), feeds.seasons),
    "season_ids": ((_LEAGUE,), feeds.season_ids), "league_teams": ((_LEAGUE,), feeds.league_teams), "rating_list": ((_LEAGUE,), feeds.rating_list),
    "stat_list": ((("list_name", "string"), ("use_sub", "boolean")), feeds.stat_list), "tournament_players": ((("tournament", "bigint"), ("page", "int")), feeds.tournament_players),
    "card_events": ((_MATCH,), feeds.card_events), "match_odds": ((_MATCH,), feeds.match_odds), "full_odds": ((_MATCH,), feeds.full_odds), "match_xg": ((_MATCH,), feeds.match_xg),
    "match_players": ((_MATCH,), feeds.match_players), "match_goals": ((_MATCH,), feeds.match_goals), "team_players": ((_TEAM,), feeds.team_players),
    "recent_matches": ((_PLAYER,), feeds.recent_matches), "current_team": ((_PLAYER,), feeds.current_team), "primary_position": ((_PLAYER,), feeds.primary_position), "rich_stats": ((_PLAYER,), feeds.rich_stats),
    "search_players": ((("term", "string"),), feeds.search_players),
}


def landed(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """All landed documents below ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedSource)
    return spark.read.format("landed").options(path=path, **options).load()


def feed(spark: SparkSession, path: str, name: str, collection: str | None = None) -> DataFrame:
    """The rows of a feed, parsed from the newest landed document of each key."""
    if name not in FEEDS:
        raise ValueError(f"no feed {name!r}; there are {', '.join(sorted(FEEDS))}")
    columns, parse = FEEDS[name]
    rows = landed(spark, path).filter(F.col("collection") == (collection or name)).filter("key is not null")
    newest = rows.groupBy("key").agg(F.max_by("doc", F.struct(F.coalesce("cached_at", F.lit(0)), "file")).alias("doc"))
    parts = F.split("key", "/", len(columns))
    return parse(newest.select(*(F.get(parts, F.lit(i)).try_cast(kind).alias(c) for i, (c, kind) in enumerate(columns)), "doc"))
