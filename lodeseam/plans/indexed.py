"""Queries that read an index: vectors by cells, substrings by 3-grams, ranking by blocks, and the index store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import postings, ranges, substring, tools, vector_index
from ..operators.steps import new_path
from ..sources.index_store import IndexStore
from .ranking import _BM25
from .registry import chunks_of, query, questions_of, table

_NEAR = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v),
s AS (SELECT q.vec_id AS qid, n.vec_id, round(list_inner_product(q.e, n.e) / (q.size * n.size), 6) AS similarity FROM n AS q JOIN n ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS vec_rank FROM s)"""


@query(f"WITH {_NEAR} SELECT qid, vec_id, similarity, vec_rank FROM r WHERE vec_rank <= 10")
def vector_index_exact(spark, sf_dir):
    """The ten nearest of all vectors by the index's cells, as many as it takes."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return vector_index.exact(vector_index.build(v), asked, 10, digits=6)


@query(f"WITH {_NEAR} SELECT qid, vec_id, similarity, vec_rank FROM r WHERE vec_rank <= 10")
def vector_blocks(spark, sf_dir):
    """The same without an index, by products of batches with blocks of queries."""
    v = table(spark, sf_dir, "embeddings")
    return vector_index.by_blocks(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), v, 10, digits=6)


def _middles(spark, sf_dir):
    """Twenty characters from the middle of each passage, as phrases."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.substring("text", 11, 20).alias("phrase"))


_PLACES = """q AS (SELECT CAST(item_id AS VARCHAR) AS qid, substr(text, 11, 20) AS phrase FROM benchmark),
h AS (SELECT qid, CAST(doc_id AS VARCHAR) AS chunk_id, text, phrase FROM q JOIN documents ON phrase <> '' AND contains(text, phrase)),
p AS (SELECT qid, chunk_id, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(phrase)) = phrase)) AS place FROM h)"""


@query(f"WITH {_PLACES} SELECT qid, chunk_id, CAST(place AS INT) AS place FROM p")
def substring_places(spark, sf_dir):
    """Where the middle of each passage stands in all documents, read from positional postings of 3-grams."""
    chunks = chunks_of(spark, sf_dir)
    return substring.find(substring.build(chunks), _middles(spark, sf_dir), chunks).select("qid", "chunk_id", F.explode("at").alias("place"))


@query(f"""WITH {_PLACES}, n AS (SELECT qid, chunk_id, 1 AS stage FROM (SELECT DISTINCT qid, chunk_id FROM p)), l AS (SELECT qid, phrase FROM q WHERE qid NOT IN (SELECT qid FROM n) AND (contains(phrase, ' ') OR length(phrase) > 8)),
w AS (SELECT qid, unnest(list_slice(list_filter(string_split_regex(phrase, '[ \\t\\n\\r\\f\\x0b，。、]+'), lambda x: x <> ''), 1, 4)) AS word FROM l),
s AS (SELECT qid, CAST(doc_id AS VARCHAR) AS chunk_id, 2 AS stage FROM w JOIN documents ON contains(text, word) GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY stage, chunk_id) AS rank FROM (SELECT * FROM n UNION ALL SELECT * FROM s)) SELECT qid, chunk_id, CAST(stage AS INT) AS stage, rank FROM r WHERE rank <= 5""")
def phrase_tool(spark, sf_dir):
    """Chunks for the middle of each passage: by phrase key (none here, as the documents have no CJK), by substring, or by words."""
    chunks = chunks_of(spark, sf_dir)
    return tools.search_phrase(_middles(spark, sf_dir), postings.phrase(chunks), chunks)


@query(f"WITH {_BM25} SELECT qid, doc_id, chunk_id, score, rank FROM top WHERE rank <= 10")
def store_topk(spark, sf_dir):
    """Ranked search that reads a stored index, and of its blocks only those that can reach a question's tenth score."""
    store = IndexStore(spark, new_path(spark))
    store.append(chunks_of(spark, sf_dir))
    found = store.top_k(questions_of(spark, sf_dir), 10, synonyms={}, digits=6)
    return found.select("qid", "doc_id", "chunk_id", F.col("bm25").alias("score"), "rank")


@query(f"WITH {_BM25.replace('FROM documents)', "FROM documents WHERE source NOT IN ('src3', 'src11'))")} SELECT qid, doc_id, chunk_id, score, rank FROM top WHERE rank <= 10")
def store_changed_topk(spark, sf_dir):
    """The same after changes: the documents come in two segments, one before and one after a deletion, another one is deleted
    from both; the ranks are those of an index of what is left."""
    store, chunks = IndexStore(spark, new_path(spark)), chunks_of(spark, sf_dir)
    old = chunks.where(F.col("doc_id") < "src15")
    gone = lambda d: chunks.where(F.col("doc_id") == d).select("domain", "doc_id").distinct()
    store.append(old)
    store.delete(gone("src11"))
    store.append(chunks.where(F.col("doc_id") >= "src15"))
    store.delete(gone("src3"))
    found = store.top_k(questions_of(spark, sf_dir), 10, synonyms={}, digits=6)
    return found.select("qid", "doc_id", "chunk_id", F.col("bm25").alias("score"), "rank")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day FROM lineitem)
SELECT a.l_partkey, count(*) AS pairs, CAST(sum(abs(a.day - b.day)) AS BIGINT) AS days FROM d AS a JOIN d AS b ON a.l_partkey = b.l_partkey AND abs(a.day - b.day) <= 5 GROUP BY 1""")
def date_range_join(spark, sf_dir):
    """Pairs of lines of one part that were shipped at most five days apart, by bins of days."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", day.alias("day"))
    met = ranges.near(lines.withColumnRenamed("day", "other"), lines, ["l_partkey"], "other", "day", 5)
    return met.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.abs(F.col("day") - F.col("other"))).cast("long").alias("days"))
