"""Containment join of two sets of strings by signatures of their grams.

A string can only stand in another one if each of its grams does, so one gram is enough to bring the two together: the one that the
fewest containers have. Strings of three or more characters have grams of three; shorter ones are a gram themselves, so a container has
its single characters and pairs as well. Only signatures are joined, and what meets is compared as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _grams(text: Column, size: int) -> Column:
    """The different grams of a size; none of a shorter text."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - (size - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.filter(F.array_distinct(each), lambda g: F.char_length(g) == size)


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) of all different pairs of a string of `inner` (column inner) that stands in one of `outer` (column outer),
    equal ones included. Null and empty strings stand in none."""
    small = inner.select("inner").where("inner != ''").distinct()
    large = outer.select("outer").where("outer != ''").distinct()
    held = large.select("outer", F.explode(F.concat(*[_grams(F.col("outer"), n) for n in (1, 2, 3)])).alias("gram"))
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    length = F.char_length("inner")
    own = small.select("inner", F.explode(F.when(length >= 3, _grams(F.col("inner"), 3)).otherwise(F.array("inner"))).alias("gram"))
    # a gram that no container has is the rarest, and leads nowhere
    rare = Window.partitionBy("inner").orderBy(F.asc_nulls_first("n"), "gram")
    sign = own.join(often, "gram", "left").withColumn("k", F.row_number().over(rare)).where("k = 1 AND n IS NOT NULL").select("inner", "gram")
    return sign.join(held, "gram").where(F.contains("outer", F.col("inner"))).select("inner", "outer")
