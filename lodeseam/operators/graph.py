"""The document graph: documents, chunks and entities, and walks from chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .containment import contained
from .steps import cut, numbered


def nodes(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, type) of documents, chunks and entity names."""
    return (
        chunks.select(F.col("doc_id").alias("id")).distinct().withColumn("type", F.lit("document"))
        .unionByName(chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("type")))
        .unionByName(entities.select(F.col("key").alias("id")).distinct().withColumn("type", F.lit("entity")))
    )


def sequence_edges(chunks: DataFrame, order: str = "chunk_no") -> DataFrame:
    """next_chunk and prev_chunk edges between neighbours in a document, of any size: chunks are numbered and meet by number."""
    here = numbered(chunks.select("doc_id", "chunk_id", F.col(order).alias("_o")), ["doc_id"], ["_o", "chunk_id"]).select("doc_id", "chunk_id", "_k")
    after = here.select("doc_id", F.col("chunk_id").alias("_to"), (F.col("_k") - 1).alias("_k"))
    pairs = here.join(after, ["doc_id", "_k"])
    there = F.struct(F.col("chunk_id").alias("src"), F.col("_to").alias("dst"), F.lit("next_chunk").alias("relation"))
    back = F.struct(F.col("_to").alias("src"), F.col("chunk_id").alias("dst"), F.lit("prev_chunk").alias("relation"))
    return pairs.select(F.explode(F.array(there, back)).alias("e")).select("e.src", "e.dst", "e.relation")


def edges(chunks: DataFrame, entities: DataFrame, order: str = "chunk_no") -> DataFrame:
    """contains (document to chunk), mentioned_in (entity to chunk, one way) and sequence edges."""
    contains = chunks.select(F.col("doc_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("contains").alias("relation"))
    mentions = entities.select(F.col("key").alias("src"), F.col("chunk_id").alias("dst"), F.lit("mentioned_in").alias("relation"))
    return contains.unionByName(mentions).unionByName(sequence_edges(chunks, order))


def expand(starts: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(qid, chunk_id, depth) reached from (qid, chunk_id) starts over edges (src, dst), each once at its least depth."""
    seen = starts.select("qid", "chunk_id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        front = front.join(edges, front["chunk_id"] == edges["src"]).select("qid", F.col("dst").alias("chunk_id")).distinct().join(seen, ["qid", "chunk_id"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def spread(starts: DataFrame, edges: DataFrame, decay=(0.8, 0.6, 0.4), most: int = 200) -> DataFrame:
    """(qid, chunk_id, score): starts with their scores, each step multiplied by its decay, the best score of a chunk kept, and
    the first `most` chunks of a question by score."""
    seen = starts.select("qid", "chunk_id", "score")
    front = seen
    for d in decay:
        front = front.join(edges, front["chunk_id"] == edges["src"]).groupBy("qid", F.col("dst").alias("chunk_id")).agg((F.max("score") * d).alias("score"))
        seen = seen.unionByName(front)
    best = seen.groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


# What is left of a score along an edge.
DECAYS = {"next_chunk": 0.8, "prev_chunk": 0.8, "mentioned_in": 0.6}
OTHER_DECAY = 0.4


def best_first(starts: DataFrame, edges: DataFrame, most: int = 200, decays: dict[str, float] = DECAYS, other: float = OTHER_DECAY) -> DataFrame:
    """(qid, chunk_id, score, depth, place): the first `most` nodes that a walk visits which always goes on at the node with the best
    score (then the smaller id), from (qid, chunk_id, score) starts over (src, dst, relation) edges. A score is multiplied along
    each edge by what its relation leaves, so it only falls, and a node's best way leads through nodes visited before it: each
    round needs to go on from the first `most` so far alone, and the walk ends with the round that changes nothing.
    """
    if not all(0 < d < 1 for d in (*decays.values(), other)):
        raise ValueError("scores must fall along each edge")
    left = F.lit(other)
    for relation, d in decays.items():
        left = F.when(F.col("relation") == relation, d).otherwise(left)
    ways = edges.select(F.col("src").alias("chunk_id"), F.col("dst").alias("_to"), left.alias("_left"))
    best = F.max(F.struct("score", (-F.col("depth")).alias("shorter"))).alias("b")
    order = Window.partitionBy("qid").orderBy(F.desc("b.score"), "chunk_id")

    def first(rows: DataFrame) -> DataFrame:
        ranked = rows.groupBy("qid", "chunk_id").agg(best).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        return ranked.select("qid", "chunk_id", F.col("b.score").alias("score"), (-F.col("b.shorter")).alias("depth"), "place")

    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("qid", "chunk_id", "score", "depth").cast("decimal(38,0)"))).first())
    now = cut(first(starts.select("qid", "chunk_id", F.col("score").cast("double").alias("score"), F.lit(0).alias("depth"))))
    before = None
    while (after := state(now)) != before:
        before = after
        further = now.join(ways, "chunk_id").select("qid", F.col("_to").alias("chunk_id"), (F.col("score") * F.col("_left")).alias("score"), (F.col("depth") + 1).alias("depth"))
        now = cut(first(now.select("qid", "chunk_id", "score", "depth").unionByName(further)))
    return now


def entity_hits(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, chunk_id, score) for (qid, name): 3 for an entity of the same name, 1 for one that contains it or is contained.
    Different names and keys meet by signatures of their grams; an empty name or key fits nothing."""
    keys, asked = entities.select("key").distinct(), names.select("qid", "name")
    one, other = names.select("name").distinct(), keys
    within = contained(one.select(F.col("name").alias("inner")), other.select(F.col("key").alias("outer"))).select(F.col("inner").alias("name"), F.col("outer").alias("key"))
    around = contained(other.select(F.col("key").alias("inner")), one.select(F.col("name").alias("outer"))).select(F.col("outer").alias("name"), F.col("inner").alias("key"))
    fits = asked.join(within.unionByName(around).distinct(), "name")
    points = fits.select("qid", "key", F.when(F.col("key") == F.col("name"), 3.0).otherwise(1.0).alias("x"))
    return points.join(entities.select("key", "chunk_id"), "key").groupBy("qid", "chunk_id").agg(F.sum("x").alias("score"))


def fuse(a: DataFrame, b: DataFrame, weight_a: float = 0.6, weight_b: float = 0.4) -> DataFrame:
    """Weighted sum of two (qid, chunk_id, score) rankings over the union of their chunks."""
    joined = a.select("qid", "chunk_id", F.col("score").alias("_a")).join(b.select("qid", "chunk_id", F.col("score").alias("_b")), ["qid", "chunk_id"], "full")
    return joined.select("qid", "chunk_id", (weight_a * F.coalesce("_a", F.lit(0.0)) + weight_b * F.coalesce("_b", F.lit(0.0))).alias("score"))


def pack(ranked: DataFrame, most: int = 8, any_tables: int = 3, any_texts: int = 5) -> DataFrame:
    """Evidence with tables first, then texts, each in order of rank, `most` in all: rows (qid, doc_id, has_table, rank, ...) and
    their place.

    A table, or text, of a document that is packed already goes in only while fewer than `any_tables`, or `any_texts`, are
    packed in all, tables included.
    """
    kind = Window.partitionBy("qid", "has_table").orderBy("rank", "doc_id")
    # Only a document's first row of a kind, and the first rows of a kind, can ever be packed: what is folded for a question
    # is bounded, however many rows are ranked.
    few = ranked.withColumn("_in_doc", F.row_number().over(Window.partitionBy("qid", "doc_id", "has_table").orderBy("rank"))).where(F.col("_in_doc") <= max(any_tables, any_texts, 1))
    few = few.withColumn("_in_kind", F.row_number().over(kind)).withColumn("_heads", F.sum((F.col("_in_doc") == 1).cast("int")).over(kind))
    few = few.where((F.col("_in_kind") <= max(any_tables, any_texts)) | ((F.col("_in_doc") == 1) & (F.col("_heads") <= 2 * most)))
    item = F.struct((~F.col("has_table")).alias("text"), "rank", "doc_id", F.struct(*ranked.columns).alias("row"))
    kinds = few.select("qid", item.alias("x")).schema["x"].dataType.simpleString()
    none = F.array().cast(f"array<{kinds}>")

    def take(packed: Column, x: Column) -> Column:
        bound = F.when(x["text"], any_texts).otherwise(any_tables)
        fits = (F.size(packed) < most) & ((F.size(packed) < bound) | ~F.exists(packed, lambda p: p["doc_id"] == x["doc_id"]))
        return F.when(fits, F.concat(packed, F.array(x))).otherwise(packed)

    packed = few.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("all")).select(F.posexplode(F.aggregate("all", none, take)).alias("_at", "x"))
    return packed.select("x.row.*", (F.col("_at") + 1).alias("place"))


def save(node_rows: DataFrame, edge_rows: DataFrame, path: str) -> None:
    """Write a graph as two tables, edges by relation."""
    node_rows.write.mode("overwrite").parquet(f"{path}/nodes")
    edge_rows.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").select("src", "dst", "relation")
