"""Tables whose rows have keys: appending those that aren't there, without reading the keys that are.

Beside a table's files lie their Bloom filters, as a Parquet table in a folder that readers of the table pass over. A filter is cut
into blocks of 256 bits, a row each. A key sets eight bits of one block, so a batch of keys meets the filters of all files by one join
on the block, and only files that may hold one of its keys are read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.steps import cut, dropped

#: Keys of a block on average, at most; 16 bits a key.
IN_BLOCK = 16
WORDS = ("w0", "w1", "w2", "w3")


def _hashed(key: str) -> list[Column]:
    """The hash that chooses a key's block, and its bits in the four words. A null is a key."""
    h = F.xxhash64(F.lit(1), F.col(key))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int"))
    return [F.xxhash64(F.lit(0), F.col(key)).alias("_h"), *[bit(12 * k).bitwiseOR(bit(12 * k + 6)).alias(w) for k, w in enumerate(WORDS)]]


def _block() -> Column:
    return F.col("_h").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")) - 1).alias("block")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _names(table: DataFrame | None) -> set[str]:
    return set() if table is None else {f.rsplit("/", 1)[-1] for f in table.inputFiles()}


def _filters_at(path: str, key: str) -> str:
    return f"{path.rstrip('/')}/_blooms_of_{key}"


def index_files(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Filters (file, level, block, w0 to w3) of all files of a table; those that have none yet are read and get one."""
    table, at = _read(spark, path), _filters_at(path, key)
    filters = _read(spark, at)
    known = set() if filters is None else {r.file for r in filters.select("file").distinct().collect()}
    missing = sorted(_names(table) - known)
    if missing:
        rows = spark.read.schema(table.schema).parquet(*[f"{path}/{f}" for f in missing])
        keys = rows.select(F.col("_metadata.file_name").alias("file"), *_hashed(key))
        sizes = keys.groupBy("file").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / IN_BLOCK))).cast("int").alias("level"))
        made = keys.join(sizes, "file").groupBy("file", "level", _block()).agg(*[F.bit_or(w).alias(w) for w in WORDS])
        made.write.mode("append").parquet(at)
        filters = _read(spark, at)
    return filters


def may_hold(keys: DataFrame, key: str, filters: DataFrame) -> DataFrame:
    """(key, file) of the files that may hold a key: all that do, and about one in a thousand of the others."""
    levels = [r.level for r in filters.select("level").distinct().collect()]  # powers of two, so few
    asked = keys.select(key, *_hashed(key)).withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("block", _block())
    met = asked.alias("a").join(filters.alias("f"), (F.col("a.level") == F.col("f.level")) & (F.col("a.block") == F.col("f.block")))
    for w in WORDS:
        met = met.where(F.col(f"a.{w}").bitwiseAND(F.col(f"f.{w}")) == F.col(f"a.{w}"))
    return met.select(f"a.{key}", "f.file")


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the Parquet table at `path` lacks; returns how many.

    Of rows with one key any one is taken; null is a key. The batch is written once to the shared folder. Files that were written by
    others, or by a run that ended before it wrote filters, get theirs first, so a repeated batch adds nothing.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    with dropped(spark):
        batch, table = cut(rows.dropDuplicates([key])), _read(spark, path)
        if table is not None and (filters := index_files(spark, path, key)) is not None:
            found = may_hold(batch, key, filters).select("file").distinct().collect()
            files = sorted({r.file for r in found} & _names(table))
            if files:
                there = spark.read.schema(table.schema).parquet(*[f"{path}/{f}" for f in files]).select(F.col(key).alias("_there"))
                batch = cut(batch.join(there, F.col(key).eqNullSafe(F.col("_there")), "left_anti"))
        n = batch.count()
        if n:
            batch.write.mode("append").parquet(path)
            index_files(spark, path, key)
    return n
