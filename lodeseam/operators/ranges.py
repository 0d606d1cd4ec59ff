"""Range joins by bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near(points: DataFrame, wanted: DataFrame, keys: list[str], at: str, around: str, radius: int) -> DataFrame:
    """All columns of `wanted` and `points` (no others in common than `keys`) where the keys are equal and the whole number `at` of a point is
    at most `radius` away from `around`.

    Numbers lie in bins of 2 * radius + 1, so a range reaches into two bins at most: wanted rows go to those, points to their own, and a
    pair meets in exactly one. Equal keys with many numbers are dealt out by bin. Null keys and numbers meet nothing.
    """
    width = F.lit(2 * radius + 1)
    bins = F.array_distinct(F.array(F.floor((F.col(around) - radius) / width), F.floor((F.col(around) + radius) / width)))
    asked = wanted.where(F.col(around).isNotNull()).withColumn("_bin", F.explode(bins))
    met = asked.join(points.withColumn("_bin", F.floor(F.col(at) / width)), [*keys, "_bin"])
    return met.where(F.abs(F.col(at) - F.col(around)) <= radius).drop("_bin")
