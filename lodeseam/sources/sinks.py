"""Writers: answers, evidence, batches and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.steps import numbered


def answer_rows(answers: DataFrame) -> DataFrame:
    """(qid, answer, prompt_tokens, completion_tokens, total_tokens) with a `summary` row of totals first, by `row`."""
    columns = ["qid", "answer", "prompt_tokens", "completion_tokens", "total_tokens"]
    total = answers.agg(F.lit("summary").alias("qid"), F.lit("").alias("answer"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns[2:]])
    rows = answers.select(*columns[:2], *[F.col(c).cast("long") for c in columns[2:]])
    return total.withColumn("row", F.lit(0)).unionByName(rows.withColumn("row", F.lit(1)))


def write_answers(answers: DataFrame, path: str) -> None:
    """One CSV file: header, totals, then answers by qid. The answers of a question set are few."""
    answer_rows(answers).coalesce(1).sortWithinPartitions("row", "qid").drop("row").write.mode("overwrite").option("header", True).csv(path)


def split_answer(answer: Column) -> list[Column]:
    """Four columns: letters stay in the first; other answers are cut at ； to four, short ones filled with ''."""
    parts = F.when(answer.rlike("^[A-Z]*$"), F.array(answer)).otherwise(F.split(answer, "；"))
    filled = F.slice(F.concat(parts, F.array_repeat(F.lit(""), 4)), 1, 4)
    return [F.get(filled, F.lit(k)).alias(f"answer_{k + 1}") for k in range(4)]


def audit(answers: DataFrame, evidence: DataFrame, quote: int = 300) -> DataFrame:
    """(qid, audit): a JSON object of each answer with its evidence by rank, quotes cut."""
    traced = evidence.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", F.substring("text", 1, quote).alias("quote")))).alias("evidence"))
    return answers.join(traced, "qid", "left").select("qid", F.to_json(F.struct("qid", "answer", "evidence")).alias("audit"))


def top_evidence(evidence: DataFrame, most: int = 20, cut: int | None = None) -> DataFrame:
    out = evidence.where(F.col("rank") <= most)
    return out if cut is None else out.withColumn("text", F.substring("text", 1, cut))


def write_by_domain(evidence: DataFrame, path: str, domains: list[str], files: int = 16) -> None:
    """A folder for each known domain, in up to `files` files by question; other domains are left out."""
    evidence.where(F.col("domain").isin(*domains)).repartition("domain", F.pmod(F.xxhash64("qid"), F.lit(files))).write.mode("overwrite").partitionBy("domain").json(path)


def batches(rows: DataFrame, size: int = 15, order: str = "qid") -> DataFrame:
    """Numbers rows in batches of `size` in order, from 0. Rows are numbered from their counts by range, not in one task."""
    return numbered(rows, [], [order]).withColumn("batch", F.floor(F.col("_k") / size).cast("long")).drop("_k", "_n")


def write_index(tables: dict[str, DataFrame], path: str, fingerprint: str) -> None:
    """Tables of an index by domain, then a manifest that names what they were made from."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("domain").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(fingerprint, sorted(tables))], "fingerprint string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_index(spark, path: str, fingerprint: str) -> dict[str, DataFrame] | None:
    """The tables of write_index(), or None if they were made from something else."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.json(f"{path}/manifest").first()
    except AnalysisException:
        return None
    if row is None or row["fingerprint"] != fingerprint:
        return None
    return {name: spark.read.parquet(f"{path}/{name}") for name in row["tables"]}


def retrieval_trace(questions: DataFrame, ranked: DataFrame, recalls: dict[str, DataFrame], most: int = 20, preview: int = 100) -> DataFrame:
    """(qid, trace): a JSON object for each question with its text (cut at 200), how many chunks each recall (qid, chunk_id) found, and
    the first chunks with score and a preview."""
    item = F.struct("rank", "chunk_id", "doc_id", "score", F.substring("text", 1, preview).alias("text_preview"))
    top = ranked.where(F.col("rank") <= most).groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("top_chunks"))
    out = questions.select("qid", F.substring("question", 1, 200).alias("question")).join(top, "qid", "left")
    for name, rows in recalls.items():
        out = out.join(rows.groupBy("qid").agg(F.count(F.lit(1)).alias(f"{name}_count")), "qid", "left").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
    return out.select("qid", F.to_json(F.struct("qid", "question", *[f"{n}_count" for n in recalls], "top_chunks")).alias("trace"))
