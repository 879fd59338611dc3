"""Freshness of cached documents, keyed upserts and positional updates on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import dims


def tiers(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in dims.TIERS.items()], "tier string, fresh_ms long, stale_ms long")


def action(age_ms: Column, fresh_ms: Column, stale_ms: Column, has_data: Column, forced: Column) -> Column:
    """serve, refresh (serve and fetch behind), or fetch; a forced refresh of a very young document is ignored."""
    young = age_ms < dims.FORCE_EVERY_MS
    return (
        F.when(age_ms.isNull() | ~has_data, "fetch").when(forced & ~young, "fetch").when(age_ms < fresh_ms, "serve").when(age_ms < stale_ms, "refresh").otherwise("fetch")
    )


def after_fetch(fetched_ok: Column, has_data: Column) -> Column:
    """What is served after a fetch: the new document, else any old one that isn't empty, else an error."""
    return F.when(fetched_ok, "new").when(has_data, "old").otherwise("error")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], created: str | None = None) -> DataFrame:
    """``new`` rows replace ``old`` rows of equal keys; a creation time stays the first one."""
    if created:
        first = old.select(*keys, F.col(created).alias("_first"))
        new = new.join(first, keys, "left").withColumn(created, F.coalesce("_first", created)).drop("_first")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last write of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in by))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def guarded(old: DataFrame, new: DataFrame) -> DataFrame:
    """An empty result leaves the data before it."""
    return old if new.isEmpty() else new


def unprocessed(matches: DataFrame, processed: DataFrame, key: str = "match_id") -> DataFrame:
    return matches.join(processed.select(key), key, "left_anti")


def update_member(rows: DataFrame, members: str, member_id: int, name: str, value: Column) -> DataFrame:
    """One field of one member of an array column."""
    return rows.withColumn(members, F.transform(members, lambda m: F.when(m["id"] == member_id, m.withField(name, value)).otherwise(m)))


def remove_member_field(rows: DataFrame, members: str, member_id: int, name: str, kind: str) -> DataFrame:
    return update_member(rows, members, member_id, name, F.lit(None).cast(kind))


def holders(rows: DataFrame, members: str, member_id: int) -> DataFrame:
    """Rows whose array holds a member."""
    return rows.filter(F.exists(members, lambda m: m["id"] == member_id))


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def all_processed(*parts: DataFrame, key: str = "match_id") -> DataFrame:
    """The distinct ids of all parts."""
    out = parts[0].select(key)
    for part in parts[1:]:
        out = out.unionByName(part.select(key))
    return out.distinct()
