"""Landed documents in versions: what a refresh reads, and what it leaves behind.

A store is a folder of Parquet parts and of manifests, numbered files that name
the parts of a version.  A version is there once its manifest is, and the
manifest is put in place last, by a rename that fails where another job has taken
the number; so readers see the version before or the one after, and a job that
dies leaves parts that no manifest names.  A part holds what one job wrote; the
newest document of a key counts, and after ``COMPACT`` parts a job writes all of
them as one.

Leases are parts of their own: (collection, key, until) of what a job is fetching.
A job leaves out keys that another holds; a lease that has run out binds nobody.
"""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPACT, TRIES = 8, 20
DOCUMENT = "collection string, key string, data string, cached_at long"
LEASE = "collection string, key string, until long"


class Conflict(RuntimeError):
    """Another job put a version in place first."""


class Store:
    """Documents (collection, key, data, cached_at) below ``folder``; times are milliseconds."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(posixpath.join(self.folder, "manifests"))
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest version: its number, its parts (oldest first) and its leases."""
        jvm, path, fs = self._files()
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        last = max((n for n in names if n.startswith("v-")), default=None)
        if last is None:
            return {"version": 0, "parts": [], "leases": []}
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, last))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, was: dict, parts: list[str], leases: list[str]) -> dict:
        """Put the version after ``was`` in place, or raise Conflict."""
        jvm, path, fs = self._files()
        now = {"version": was["version"] + 1, "parts": parts, "leases": leases}
        own, to = jvm.org.apache.hadoop.fs.Path(path, f"new-{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path, f"v-{now['version']:012d}")
        out = fs.create(own, False)
        try:
            out.write(bytearray(json.dumps(now).encode()))
        finally:
            out.close()
        if fs.exists(to) or not fs.rename(own, to):
            fs.delete(own, False)
            raise Conflict(f"version {now['version']} is taken")
        return now

    def change(self, make) -> dict:
        """Put ``make(manifest)`` = (parts, leases) in place, anew where another job was first."""
        for _ in range(TRIES):
            was = self.manifest()
            try:
                return self._put(was, *make(was))
            except Conflict:
                continue
        raise Conflict(f"{TRIES} versions were taken by others")

    def part(self, rows: DataFrame) -> str:
        """Write a part that no version names yet."""
        path = posixpath.join(self.folder, "parts", uuid.uuid4().hex)
        rows.write.parquet(path)
        return path

    def _all(self, parts: list[str], schema: str) -> DataFrame:
        rows = None
        for no, path in enumerate(parts):
            own = self.spark.read.schema(schema).parquet(path).withColumn("part", F.lit(no))
            rows = own if rows is None else rows.unionByName(own)
        return self.spark.createDataFrame([], f"{schema}, part int") if rows is None else rows

    def read(self, manifest: dict | None = None) -> DataFrame:
        """The newest document of each key."""
        rows = self._all((manifest or self.manifest())["parts"], DOCUMENT)
        newest = Window.partitionBy("collection", "key").orderBy(F.desc("cached_at"), F.desc("part"))
        return rows.withColumn("place", F.row_number().over(newest)).filter("place = 1").drop("place", "part")

    def land(self, rows: DataFrame, release: str | None = None) -> dict:
        """A version with ``rows`` on top; ``release``: a lease that ends with it."""
        own = self.part(rows.select("collection", "key", "data", "cached_at"))

        def make(was: dict) -> tuple[list[str], list[str]]:
            parts = [*was["parts"], own]
            if len(parts) > COMPACT:
                parts = [self.part(self.read({"parts": parts}))]
            return parts, [x for x in was["leases"] if x != release]

        return self.change(make)

    def leased(self, now: int, manifest: dict | None = None) -> DataFrame:
        """Keys that jobs hold."""
        return self._all((manifest or self.manifest())["leases"], LEASE).filter(F.col("until") > now).select("collection", "key").distinct()

    def lease(self, keys: DataFrame, now: int, hold: int) -> tuple[str, DataFrame]:
        """Take a lease of those ``keys`` (collection, key) that nobody holds; (its name, the keys taken)."""
        name = ""

        def make(was: dict) -> tuple[list[str], list[str]]:
            nonlocal name
            free = keys.select("collection", "key").distinct().join(self.leased(now, was), ["collection", "key"], "left_anti")
            name = self.part(free.withColumn("until", F.lit(now + hold).cast("long")))
            return was["parts"], [*was["leases"], name]

        self.change(make)
        return name, self.spark.read.schema(LEASE).parquet(name).select("collection", "key")

    def release(self, name: str) -> dict:
        return self.change(lambda was: (was["parts"], [x for x in was["leases"] if x != name]))
