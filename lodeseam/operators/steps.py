"""Cutting the lineage of tables that are used more than once or grow by rounds."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: `spark.checkpoint.dir`, or one of our own where that is unset and all is one
    process."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and context._jsc.sc().getCheckpointDir().isDefined():
        at = context._jsc.sc().getCheckpointDir().get()
    if at is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodeseam-"))
        at = context._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends, if not before."""
    path = f"{shared_folder(spark)}/lodeseam-steps-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, **options: str) -> DataFrame:
    """The table, written once to a new_path(), with options of its writer, and read back."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.options(**options).parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths that cut() wrote, in order, but for those that dropped() removed.
_MADE: list[str] = []


@contextlib.contextmanager
def dropped(spark: SparkSession) -> Iterator[None]:
    """What cut() writes within is removed at the end: for calls that have collected their result by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[before:]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        del _MADE[before:]


def spread(df: DataFrame, *keys: str, times: int = 4) -> DataFrame:
    """The table dealt by keys to `times` tasks a core. A file of few bytes is one task's, however much is done with each row, and tables
    dealt without a number are put together again by their bytes."""
    return df.repartition(times * df.sparkSession.sparkContext.defaultParallelism, *keys)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The table, written once, with _k, a row's number from 0 in its group by `order`, and _n, the rows of the group.

    Rows are dealt by ranges of group and order and numbered there; what lies before a range in its group is added from the
    counts. So even a group that holds all rows is no task's burden. Rows that agree in all of `order` are numbered in any order.
    """
    ranged = cut(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_part", *group)
    counts = ranged.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_here"))
    # a row for each range that a group has rows in
    over = Window.partitionBy(*group)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_here").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_here").over(over))
    ranked = ranged.withColumn("_row", F.row_number().over(here.orderBy(*order)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("_part", *group)]
    met = ranked.alias("r").join(counts.alias("c"), same)
    return met.select("r.*", (F.col("c._before") + F.col("r._row") - 1).alias("_k"), F.col("c._n").alias("_n")).drop("_part", "_row")


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """The table, written once, with a column for each name of `sums`: the sum of that column (a whole number) over the rows before a
    row in its group by `order`, which must be total. Dealt as by numbered()."""
    ranged = cut(df.repartitionByRange(*group, *order).select("*", F.spark_partition_id().alias("_part"), *[F.coalesce(c.cast("long"), F.lit(0)).alias(f"_of_{n}") for n, c in sums.items()]))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    here, over = before(Window.partitionBy("_part", *group).orderBy(*order)), before(Window.partitionBy(*group).orderBy("_part"))
    # a row for each range that a group has rows in
    totals = ranged.groupBy("_part", *group).agg(*[F.sum(f"_of_{n}").alias(f"_of_{n}") for n in sums])
    totals = totals.select("_part", *group, *[F.coalesce(F.sum(f"_of_{n}").over(over), F.lit(0)).alias(f"_before_{n}") for n in sums])
    summed = ranged.select("*", *[F.coalesce(F.sum(f"_of_{n}").over(here), F.lit(0)).alias(f"_here_{n}") for n in sums])
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("_part", *group)]
    met = summed.alias("r").join(totals.alias("c"), same)
    return met.select(*[f"r.{c}" for c in df.columns], *[(F.col(f"c._before_{n}") + F.col(f"r._here_{n}")).alias(n) for n in sums])
