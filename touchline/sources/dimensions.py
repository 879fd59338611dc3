"""The fixed dimensions of ``dims`` as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline import dims


def leagues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in dims.LEAGUES.items()], "league_id int, name string, country string, country_code string, tournament_id int")


def positions(spark: SparkSession) -> DataFrame:
    """Positions with their group and the group's place."""
    return spark.createDataFrame([(p, g, dims.GROUP_ORDER[g]) for p, g in dims.POSITION_GROUP.items()], "position string, grp string, place int")


def slots(spark: SparkSession) -> DataFrame:
    """A row for each slot of each formation and each position it takes."""
    rows = [(name, i, p) for name, slots_ in dims.SLOTS.items() for i, taken in enumerate(slots_) for p in taken]
    return spark.createDataFrame(rows, "formation string, slot int, position string")


def malus(spark: SparkSession) -> DataFrame:
    rows = [(slot, native, v) for slot, own in dims.MALUS.items() for native, v in own.items()]
    return spark.createDataFrame(rows, "slot string, position string, malus double")


def weights(spark: SparkSession) -> DataFrame:
    """Weights of the score by group, a row for each."""
    return spark.createDataFrame([(g, n, v) for g, own in dims.WEIGHTS.items() for n, v in zip(dims.WEIGHT_NAMES, own, strict=True)], "grp string, name string, weight double")


def priors(spark: SparkSession) -> DataFrame:
    """Chances of a win and a loss by difficulty."""
    return spark.createDataFrame([(d, p, dims.LOSS_BY_DIFFICULTY[d]) for d, p in dims.WIN_BY_DIFFICULTY.items()], "difficulty int, win double, loss double")
