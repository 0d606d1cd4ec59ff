"""Sizes of stated sets, checked before they are sent to all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes that one broadcast may have.
MOST = 64 << 20


def size_of(df: DataFrame) -> int:
    """Bytes of a table's values as text with their names, and 64 for each row; one pass over it."""
    # as many as JSON would have, which is only made of what is no string
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    other = [c for c in df.columns if c not in plain]
    bytes_ = [F.coalesce(F.octet_length(c) + len(c.encode()) + 6, F.lit(0)) for c in plain] + ([F.octet_length(F.to_json(F.struct(*other)))] if other else [])
    return df.agg(F.sum(sum(bytes_, F.lit(64)))).first()[0] or 0


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """The table, to be broadcast if it fits; otherwise the optimiser chooses."""
    return F.broadcast(df) if size_of(df) <= most else df


def scan(queries: DataFrame, rows: DataFrame, condition: Column, of: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """Rows that meet a condition with a query of a stated set, which is held against all rows in blocks that fit a broadcast. `of`
    is the set whose size is checked, if `queries` comes from it by some work."""
    blocks = max(1, -(-size_of(queries if of is None else of) // most))
    if blocks == 1:
        return rows.join(F.broadcast(queries), condition)
    dealt, out = F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)), None
    for k in range(blocks):
        part = rows.join(F.broadcast(queries.where(dealt == k)), condition)
        out = part if out is None else out.unionByName(part)
    return out
