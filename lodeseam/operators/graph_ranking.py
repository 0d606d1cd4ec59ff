"""Rankings over the graph's indexes: symbol weights, idf of phrases, entities with decay, and number boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract
from .graph import fuse
from .sizes import scan

__all__ = ["fuse", "idf_search", "keyword_fallback", "number_boost", "score_walk", "symbol_recall"]

def _asked(questions: DataFrame) -> DataFrame:
    options = F.array_join(F.map_values("options"), " ") if "options" in questions.columns else F.lit("")
    return questions.withColumn("_q", F.concat_ws(" ", "question", options))

def symbol_recall(questions: DataFrame, symbols: DataFrame, keywords: int = 10, keyword_weight: float = 0.3) -> DataFrame:
    """(qid, chunk_id, score): sum of the weights of shared symbols; the first ten keywords count 0.3 of theirs."""
    q = _asked(questions)
    asked = {
        "metric": extract.symbol_metrics(F.col("_q")), "period": extract.symbol_periods(F.col("_q")), "number": extract.symbol_numbers(F.col("_q")), "clause": extract.symbol_clauses(F.col("_q")),
        "keyword": F.slice(extract.symbol_keywords(F.col("_q")), 1, keywords),
    }
    rows = None
    for family, keys in asked.items():
        df = q.select("qid", F.lit(family).alias("family"), F.explode(F.array_distinct(keys)).alias("symbol"))
        rows = df if rows is None else rows.unionByName(df)
    hits = rows.join(symbols, ["family", "symbol"])
    return hits.groupBy("qid", "chunk_id").agg(F.sum(F.col("weight") * F.when(F.col("family") == "keyword", keyword_weight).otherwise(1.0)).alias("score"))

def idf_search(questions: DataFrame, scope: DataFrame, phrases: DataFrame, inverted: DataFrame, numbers: DataFrame) -> DataFrame:
    """(qid, chunk_id, score) within a scope (qid, chunk_id): CJK runs of 2 to 6 by min(ln(N / df) + 1, 10), N of the scope and df of
    the whole index: three times for phrase keys, once for keys between punctuation if their df differs; 50 for each number."""
    q = _asked(questions)
    n = scope.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    keys = q.select("qid", F.explode(extract.phrases(F.col("_q"), 2, 6)).alias("key")).join(n, "qid")
    df_p = phrases.groupBy("key").agg(F.count(F.lit(1)).alias("df_p"))
    df_i = inverted.groupBy("key").agg(F.count(F.lit(1)).alias("df_i"))
    keys = keys.join(df_p, "key", "left").join(df_i, "key", "left")
    idf = lambda c: F.least(F.log(F.col("n") / F.col(c)) + 1, F.lit(10.0))
    a = keys.where("df_p is not null").select("qid", "key", (idf("df_p") * 3).alias("w")).join(phrases.select("key", "chunk_id"), "key")
    b = keys.where("df_i is not null and (df_p is null or df_i != df_p)").select("qid", "key", idf("df_i").alias("w")).join(inverted.select("key", "chunk_id"), "key")
    c = q.select("qid", F.explode(extract.found(F.col("_q"), extract.NUMBER)).alias("key"), F.lit(50.0).alias("w")).join(numbers.select("key", "chunk_id"), "key")
    rows = a.select("qid", "chunk_id", "w").unionByName(b.select("qid", "chunk_id", "w")).unionByName(c.select("qid", "chunk_id", "w"))
    return rows.join(scope.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_semi").groupBy("qid", "chunk_id").agg(F.sum("w").alias("score"))

def score_walk(reached: DataFrame, chunks: DataFrame, names: DataFrame, entities: DataFrame, decay: float = 0.85, domain_boost: float = 1.5, table_boost: float = 1.3) -> DataFrame:
    """(qid, chunk_id, score) of chunks reached at a depth (qid, chunk_id, depth, domain): twice the share of three entities met, 0.3
    for each name in the text, decay by depth, and factors for the question's domain and for tables."""
    keys = entities.select("key").distinct()
    fits = scan(names.select("name").distinct(), keys, F.contains("key", F.col("name")) | F.contains("name", F.col("key")), names)
    met = names.join(fits, "name").join(entities.select("key", "chunk_id"), "key").groupBy("qid", "chunk_id").agg(F.count_distinct("name", "key").alias("met"))
    listed = names.groupBy("qid").agg(F.collect_set("name").alias("names"))
    df = reached.withColumnRenamed("domain", "_d").join(chunks.select("chunk_id", "domain", "text", "has_table"), "chunk_id").join(met, ["qid", "chunk_id"], "left").join(listed, "qid", "left")
    base = F.least(F.coalesce("met", F.lit(0)) / 3.0, F.lit(1.0)) * 2 + 0.3 * F.size(F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda x: F.contains("text", x)))
    factor = F.pow(F.lit(decay), F.col("depth")) * F.when(F.col("_d") == F.col("domain"), domain_boost).otherwise(1.0) * F.when(F.col("has_table"), table_boost).otherwise(1.0)
    return df.select("qid", "chunk_id", (base * factor).alias("score"))

def number_boost(scores: DataFrame, matches: DataFrame, factor: float = 5.0, missing: float = 50.0) -> DataFrame:
    """Scores (qid, chunk_id, score) times 1 + factor * m for m numbers met (qid, chunk_id, m); chunks without a score get missing * m."""
    joined = scores.join(matches, ["qid", "chunk_id"], "full")
    m = F.coalesce("m", F.lit(0))
    return joined.select("qid", "chunk_id", F.when(F.col("score").isNull(), missing * m).otherwise(F.col("score") * (1 + factor * m)).alias("score"))

def keyword_fallback(questions: DataFrame, chunks: DataFrame, most: int = 8) -> DataFrame:
    """(qid, chunk_id, score, rank): chunks by how many of the question's keywords they have. For the few questions that nothing else
    answers: all of them are held against every chunk."""
    words = questions.select("qid", extract.cjk_keywords(F.col("question")).alias("_k"))
    hits = scan(words, chunks, F.exists("_k", lambda k: F.contains("text", k)), questions).select("qid", "chunk_id", F.size(F.filter("_k", lambda k: F.contains("text", k))).alias("score"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= most)
