"""The scan of a folder of landed match files as a stream: each file once, rows sorted into good, skipped and corrupt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_SIDE = "struct<id: long, name: string, score: int>"
MATCH = f"id long, date string, league int, season string, round string, h {_SIDE}, a {_SIDE}, corrupt string"


def match_files(spark: SparkSession, folder: str, files_at_once: int | None = None, whole_files: bool = False) -> DataFrame:
    """A stream of (match_id, dt, league, season, round, h, a, hs, as_, status, file, landed_at) of match documents.

    ``status``: ``good``; ``skipped`` where a score or a date is missing (or the date
    can't be read); ``corrupt`` where a line isn't a match document at all: its text
    is in ``corrupt``.  ``whole_files``: a file is one document, not one to a line.
    """
    reader = spark.readStream.schema(MATCH).option("columnNameOfCorruptRecord", "corrupt").option("mode", "PERMISSIVE").option("multiLine", str(whole_files).lower())
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    rows = reader.json(folder).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("landed_at"))
    return rows.select(
        F.col("id").alias("match_id"), F.try_to_timestamp("date").alias("dt"), "league", "season", "round", F.col("h.id").alias("h"), F.col("a.id").alias("a"),
        F.col("h.score").alias("hs"), F.col("a.score").alias("as_"), _status().alias("status"), "corrupt", "file", "landed_at",
    )


def _status() -> Column:
    usable = F.col("h.score").isNotNull() & F.col("a.score").isNotNull() & F.try_to_timestamp("date").isNotNull()
    return F.when(F.col("corrupt").isNotNull() | F.col("id").isNull(), "corrupt").when(usable, "good").otherwise("skipped")


def scan_matches(spark: SparkSession, folder: str, table: str, checkpoint: str, **options) -> StreamingQuery:
    """Take the files that landed since the last scan and end; rows are added to ``table`` in folders by status."""
    rows = match_files(spark, folder, **options)
    return rows.writeStream.format("parquet").partitionBy("status").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scanned(spark: SparkSession, table: str, status: str = "good") -> DataFrame:
    """What scans have taken so far."""
    return spark.read.parquet(table).filter(F.col("status") == status)
