"""Where queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its DuckDB SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of the documents that their sources are."""
    return table(spark, sf_dir, "documents").select(F.lit("corpus").alias("domain"), F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("chunk_no"), "text", F.contains("text", F.lit("|")).alias("has_table"), F.lit(1).alias("page"))


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.lit("corpus").alias("domain"), F.col("text").alias("question"))
