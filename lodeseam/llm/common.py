"""Pieces that several training-data operators share: the shared folder, joins
that survive hot keys, connected components and the text rules of the contracts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
#: A key is hot if it holds over 1/HOT_PARTS of the rows, so there are fewer than HOT_PARTS hot keys at any size.
HOT_PARTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: `spark.checkpoint.dir`, or, where that is unset and all is one process
    (tests), one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodeseam-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at


#: Paths made and not yet removed, in order.
_MADE: dict[str, None] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by drop() or release(), at the latest when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lodeseam-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    _MADE[path] = None
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _MADE.pop(path, None)


def made() -> set[str]:
    """The paths in use now; see release()."""
    return set(_MADE)


def release(spark: SparkSession, keep: set[str]) -> None:
    """Remove all paths made by this driver but `keep`: what a result was read from that is itself written or used up by now."""
    for path in [p for p in _MADE if p not in keep]:
        delete_folder(spark, path)


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back. A lost executor costs only its running tasks."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that save() wrote and nothing reads any more."""
    for t in tables:
        delete_folder(t.sparkSession, t.saved_at)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str = "left") -> DataFrame:
    """`left` joined to at most one row of `right` a key, with no task for a whole hot key.

    `rows` names a column of `right` with the number of rows that `left` has for the key; it is dropped. Keys with over
    1/HOT_PARTS of all those rows are fewer than HOT_PARTS by counting, so that part of `right` is broadcast, and rows
    of `left` with a hot key are dealt by a hash of the row. Keys are compared null-safe.
    """
    payload = [c for c in right.columns if c not in keys and c != rows]
    total = right.agg(F.sum(rows)).first()[0] or 0
    least = max(total // HOT_PARTS, 1000)
    tag = uuid.uuid4().hex[:8]
    named = lambda df, what: df.select(*[F.col(k).alias(f"_{what}{i}_{tag}") for i, k in enumerate(keys)], *[F.col(p).alias(f"_{what}_{p}_{tag}") for p in payload], F.lit(True).alias(f"_{what}_{tag}"))
    hot = F.broadcast(named(right.where(F.col(rows) > least), "h"))
    cold = named(right.where(F.col(rows) <= least), "c").withColumn(f"_c_salt_{tag}", F.lit(-1))
    same = lambda what: [F.col(k).eqNullSafe(F.col(f"_{what}{i}_{tag}")) for i, k in enumerate(keys)]
    # by what a row holds and where it is, so that a task that is run again deals its rows as before, in whatever order they come
    dealt = F.xxhash64(F.spark_partition_id(), *[F.col(f.name) for f in left.schema.fields if "map<" not in f.dataType.simpleString()])
    out = left.join(hot, reduce(Column.__and__, same("h")), "left")
    out = out.withColumn(f"_salt_{tag}", F.when(F.col(f"_h_{tag}"), F.pmod(dealt, F.lit(100_000)).cast("int")).otherwise(F.lit(-1)))
    out = out.join(cold, reduce(Column.__and__, same("c"), F.col(f"_salt_{tag}") == F.col(f"_c_salt_{tag}")), "left")
    if how == "inner":
        out = out.where(F.col(f"_h_{tag}") | F.col(f"_c_{tag}"))
    return out.select(*left.columns, *[F.when(F.col(f"_h_{tag}"), F.col(f"_h_{p}_{tag}")).otherwise(F.col(f"_c_{p}_{tag}")).alias(p) for p in payload])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long ids, as (node, root) with the smallest id of a component as root.

    Alternates large-star and small-star steps until no edge changes; each round is a written table. The smallest
    neighbour of a node is found by partial aggregation and joined back by join_hot(), so a hub is no task's burden.
    Nodes without an edge to another node are not returned.
    """
    spark = edges.sparkSession

    def star(now: DataFrame, large: bool) -> DataFrame:
        # (u, v): a node and its neighbour. large: all neighbours, kept if larger than u; small: the smaller ones.
        pairs = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            pairs = pairs.unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        met = join_hot(pairs, least, ["u"], "n")
        moved = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
        return moved.where("a != b").distinct()

    now = save(edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a != b").distinct(), "edges")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(now)
    while before[0]:
        big = save(star(now, True), "large")
        nxt = save(star(big, False), "small")
        drop(now, big)
        now, after = nxt, state(nxt)
        if after == before:
            break
        before = after
    # every edge now leads from a node to the root of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def texts(batch: pa.RecordBatch, column: int = 1) -> list[bytes]:
    """UTF-8 texts of a column; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def each_batch(function, *columns_of_schema) -> object:
    """A mapInArrow function from one that turns a RecordBatch into columns."""
    names = [n for n, _ in columns_of_schema]
    kinds = [k for _, k in columns_of_schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(function(batch), kinds, strict=True)], names=names)

    return run
