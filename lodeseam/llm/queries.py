"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, jaccard, language_id, licenses, lines, packing, quality, simhash, substrings, token_store, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(index, payloads=False).drop("payload")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~out))
    return language_id.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read(token_store.write(_table(spark, sf_dir, "documents")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it is over 2**63 - 1; the operator has it whole, as a decimal."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_license_scan, op2_line_dedup, op3_warc_index, op4_language_id, op5_simhash_near_dedup, op6_token_ids, op7_substring_dedup, op8_best_fit_packing, op9_quality_rules,
    op10_decontamination, op11_centroid_clustering, op12_embedding_whitening, op13_ngram_jaccard_join,
)
QUERIES = {f.__name__: f for f in _ALL}

_STOP_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))


def _license_sql() -> str:
    """The scan in SQL: the same patterns, the known digests and notices as values."""
    text = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '(?m)" + licenses.COPYRIGHT + r"', '', 'g'), '[^\p{L}\p{N}\n]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    for a, b in licenses.SPELLINGS.items():
        text = rf"regexp_replace({text}, '\b{a}\b', '{b}', 'g')"
    digests = ", ".join(f"('{d}', '{n}')" for n, d in licenses.DIGESTS)
    told = ", ".join(f"'{t}': '{n}'" for t, n in licenses.notices().items())
    return f"""
WITH known(text_sha256, license) AS (VALUES {digests}), c AS (SELECT doc_id, {text} AS t FROM documents),
s AS (SELECT doc_id, sha256(replace(t, chr(10), ' ')) AS text_sha256, list_filter(list_transform(string_split(t, chr(10)), lambda x: MAP {{{told}}}[x]), lambda x: x IS NOT NULL) AS n FROM c)
SELECT doc_id, text_sha256, license, coalesce(array_to_string(list_sort(list_distinct(n)), ','), '') AS notices FROM s LEFT JOIN known USING (text_sha256)"""


ORACLE_SQL = {
    "op1_license_scan": _license_sql(),
    "op9_quality_rules": rf"""
WITH w AS (
  SELECT doc_id, text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM c, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(words, lambda x: x IN ({_STOP_LIST}))) AS n_stop, len(lines) AS n_lines
  FROM w LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 1000000 AND word_chars >= 2.0 * n_words AND word_chars <= 14.0 * n_words
       AND n_symbols <= 0.1 * n_words AND n_stop >= 0.02 * n_words AND n_dup_lines <= 0.5 * n_lines AS kept
FROM b""",
}
