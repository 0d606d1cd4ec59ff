"""Exact nearest chunks by cosine, over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector_index import by_blocks


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, scope: str | None = None, digits: int | None = None) -> DataFrame:
    """(qid, vec_id, similarity, vec_rank) of the k nearest of `vectors` (vec_id, embedding[, scope]) for each of `queries`
    (qid, embedding[, scope]), equal scopes only if `scope` is named. All vectors are looked at for a stated query set, which goes to all
    tasks in blocks of a checked size; each task keeps k rows a query. Rows without a direction, as null and zero vectors, have no cosine and
    are left out. For a stored index see vector_index."""
    return by_blocks(queries, vectors, k, digits, scope)
