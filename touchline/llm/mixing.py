"""Mixing sources to target weights: hash-random order, range bins, prefix sums, exact cuts.

DataFrame functions only.  Semantics for odd input: a null text has size 0; null
is a source of its own, sorted last; repeated rows are separate documents of the
source; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weights dealt to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Range bins of the hash key in each source (16 ** 3): a prefix sum needs one row
#: for a bin, and a sort only within the bin where a source's budget ends.
BIN_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets of sources from rows (source, source_size), one for each source.

    All sizes together are shared by weight.  A target stops at ``max_repeat``
    times its source's size and the excess is shared among the rest by weight:
    in order of size over weight, a source stops while an equal level for it
    and all later ones lies at or above its stop.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before, rest = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    every = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sizes.select("source", "source_size", deal.cast("long").alias("weight"))
        .withColumn("stop", F.lit(max_repeat) * F.col("source_size"))
        .withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(rest))
        .withColumn("stops", F.col("left_words") * F.col("weight") >= F.col("stop") * F.col("left_weight"))
        .withColumn("free_words", F.sum("source_size").over(every) - F.sum(F.when(F.col("stops"), F.col("stop")).otherwise(0)).over(every))
        .withColumn("free_weight", F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(every))
        .select(
            "source",
            "source_size",
            F.when(F.col("stops"), F.col("stop").cast("double"))
            .otherwise((F.col("weight") * F.col("free_words")).cast("double") / F.when(F.col("stops"), 1).otherwise(F.col("free_weight")).cast("double"))
            .alias("target"),
        )
    )


def mix_sources(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: str = "mix-1",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document.

    A source's budget is its rounded target.  It takes whole epochs of the
    source while they fit, then documents in hash-random order up to the exact
    budget; the last one is taken in part.  ``taken`` counts the words of all
    epochs.  Reruns agree, since the order is a hash of seed and id, then id,
    size and a hash of the text.
    """
    rows = cut(documents.select(*_keys(id_col, text_col, source_col, seed)))
    return _deal(rows, weights, max_repeat).select("doc_id", "source", "size", "source_size", "target", "taken")


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _keys(id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), key.alias("key"), F.xxhash64(text_col).alias("tie")]


def _deal(rows: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """Adds source_size, target and taken to rows (doc_id, source, size, key, tie) with any further columns."""
    sized = rows.withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    # Every hot source is spread over its bins, so no step has a key with a large share of the rows.
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, max_repeat)
    budget = F.floor(F.col("target") + 0.5)
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        _join(bins, targets, ["source"])
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
        .withColumn("room", budget - F.col("epochs") * F.col("source_size") - F.coalesce(F.sum("bin_size").over(by_bin), F.lit(0)))
        .withColumn("inside", (F.col("room") > 0) & (F.col("room") < F.col("bin_size")))
        .drop("bin_size")
    )
    dealt = _join(sized, cuts, ["source", "bin"])
    in_bin = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    apart = dealt.filter(F.col("inside")).withColumn("extra", _clip(F.col("room") - F.coalesce(F.sum("size").over(in_bin), F.lit(0))))
    whole = dealt.filter(~F.col("inside")).withColumn("extra", F.when(F.col("room") > 0, F.col("size")).otherwise(0))
    return apart.unionByName(whole).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long"))


def _clip(room: Column) -> Column:
    return F.greatest(F.lit(0), F.least(room, F.col("size")))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that treats null as a value in the first key, which keeps an equality on all."""
    other = [c for c in right.columns if c not in keys]
    right = right.select(*(F.col(k).alias(f"_right_{k}") for k in keys), *other)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(right, on).drop(*(f"_right_{k}" for k in keys))


def emit_mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = "mix-1") -> DataFrame:
    """The documents (doc_id, text, source) that ``mix_sources`` takes, with all their columns, once for each epoch.

    A document whose last epoch is cut gives that many of its first words,
    joined by spaces, as a further row.  ``n_chars``, where there is such a
    column, is counted anew.  Each row has its own share, whatever its id, so
    exactly the budget is emitted; columns may have any names, as they travel in
    a struct.
    """
    rows = _deal(documents.select(*_keys("doc_id", "text", "source", seed), F.struct("*").alias("doc")), weights, max_repeat)
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    rest = F.col("taken") - full * F.col("size")
    epochs = F.concat(F.array_repeat(F.col("size"), full.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("doc", "size", F.explode(epochs).alias("part"))
    own = F.col("doc").getField("text")
    first_words = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(f"({WORD})")), 1, F.col("part").cast("int")), " ")
    rows = rows.select("doc", F.when(F.col("part") == F.col("size"), own).otherwise(first_words).alias("text"))
    made = {"text": F.col("text"), "n_chars": F.length("text")}
    kinds = {f.name: f.dataType for f in documents.schema}
    return rows.select(*((made[c].cast(kinds[c]) if c in made else F.col("doc").getField(c)).alias(c) for c in documents.columns))
