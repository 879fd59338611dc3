"""Blocks of candidate rows, named by a hub, that one task each can join.

A block of at most ``cell`` members is one part.  A larger one is dealt to parts
by hash, its hub to all of them; members found to link with the hub are
connected through it, so afterwards only the others go to every part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(pairs: DataFrame, cell: int) -> DataFrame:
    """(hub, mark, parts, part, spread) of distinct (hub, mark)."""
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("sets"))
    placed = pairs.join(sizes, "hub").withColumn("parts", F.ceil(F.col("sets") / cell).cast("int")).drop("sets")
    own = F.array(F.pmod(F.xxhash64("mark"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    part = F.when(F.col("parts") <= 1, F.array(F.lit(0))).when(F.col("mark") == F.col("hub"), every).otherwise(own)
    return placed.withColumn("part", F.explode(part)).withColumn("spread", F.lit(False))


def deal_again(split: DataFrame, apart: DataFrame) -> DataFrame:
    """The second deal of blocks of several parts, given their members (hub, mark) that don't link to the hub.

    Those go to every part, marked ``spread``; the others stay in their part.
    Blocks without such members are done.
    """
    apart = apart.select("hub", "mark").distinct().withColumn("is_apart", F.lit(True))
    again = split.filter("mark <> hub").join(apart, ["hub", "mark"], "left")
    part = F.when(F.col("is_apart"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    again = again.select("hub", "mark", "parts", F.explode(part).alias("part"), F.coalesce("is_apart", F.lit(False)).alias("spread"))
    return again.join(again.filter("spread").select("hub").distinct(), "hub", "left_semi")
