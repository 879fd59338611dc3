"""The refresh job behind freshness: one batch of requests, answered from a store and brought up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import freshness
from touchline.sources.landed import Store
from touchline.sources.landing import keep

HOLD_MS = 60_000
_KEY = ["collection", "key"]


def refresh(store: Store, requests: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: int, hold: int = HOLD_MS) -> DataFrame:
    """Answer ``requests`` (collection, key, forced; further columns are carried) as of ``now``; adds action, outcome and data.

    What is due is leased, fetched and landed as one version of the store, in which
    keys that another job holds keep what they have.  ``fetch`` takes (collection,
    key) and gives (collection, key, data) of what it could get; a key that it
    leaves out, a null and an empty list are failures and change nothing.

    ``outcome``: kept (young enough, or forced too soon), stale (answered with the
    old document, fetched behind), fetched, old (nothing could be fetched, the old
    one stands in) or error.  If the job fails, its lease is given back and the
    store stays as it was.  Requests for one key get one fetch and the same answer;
    a collection without a tier is always due.
    """
    was = store.manifest()
    # a batch is decided once: later steps see the same, whatever lands meanwhile
    have = store.read(was).withColumnRenamed("data", "old")
    some = F.col("old").isNotNull() & (F.trim("old") != "[]")
    rows = requests.join(have, _KEY, "left").join(F.broadcast(freshness.tiers(store.spark).withColumnRenamed("tier", "collection")), "collection", "left")
    age, has = F.lit(now) - F.col("cached_at"), F.coalesce(some, F.lit(False))
    act = F.coalesce(freshness.action(age, F.coalesce("fresh_ms", F.lit(0)), F.coalesce("stale_ms", F.lit(0)), has, F.coalesce("forced", F.lit(False))), F.lit("fetch"))
    planned = keep(rows.withColumn("action", act).withColumn("has", has).drop("cached_at", "fresh_ms", "stale_ms"))
    lease, mine = store.lease(planned.filter("action <> 'serve'"), now, hold)
    try:
        got = keep(fetch(mine).filter(F.col("data").isNotNull() & (F.trim("data") != "[]")).groupBy(*_KEY).agg(F.max("data").alias("new")).join(mine, _KEY, "left_semi"))
        store.land(got.select(*_KEY, F.col("new").alias("data"), F.lit(now).cast("long").alias("cached_at")), lease)
    except BaseException:
        store.release(lease)
        raise
    answered = planned.join(got, _KEY, "left")
    outcome = (
        F.when(F.col("action") == "serve", "kept").when(F.col("action") == "refresh", "stale").when(F.col("new").isNotNull(), "fetched").when(F.col("has"), "old").otherwise("error")
    )
    data = F.when(F.col("action").isin("serve", "refresh"), F.col("old")).when(F.col("new").isNotNull(), F.col("new")).when(F.col("has"), F.col("old"))
    return answered.withColumn("outcome", outcome).withColumn("data", data).drop("old", "new", "has")
