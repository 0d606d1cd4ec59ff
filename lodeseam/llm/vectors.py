"""Embedding columns as whole-number matrices, for the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Entries are handled as doubles, which hold whole numbers up to here.
LARGEST = float(1 << 52)


def finite(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: numbers of the rows without a null, a missing or a non-finite entry, their lengths, and all their
    entries one after another as doubles."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(lists.value_lengths().fill_null(-1))
    there = np.flatnonzero(sizes >= 0)
    flat = lists.flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes[there])
    wrong = np.r_[0, np.cumsum(~np.isfinite(values))]
    good = wrong[ends] == wrong[ends - sizes[there]]
    return there[good], sizes[there][good], values[np.repeat(good, sizes[there])]


def whole_numbers(vectors: DataFrame, scale: int, shift: int, name: str) -> DataFrame:
    """A written table (vec_id, x array<long>): x = floor(scale * entry) + shift of each vector that has no null and no
    non-finite entry. Null vectors go; an entry that leaves the whole numbers of a double raises ValueError."""

    def run(batches):
        for batch in batches:
            rows, sizes, values = finite(batch.column(1))
            x = np.floor(values * scale) + shift
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"an entry times {scale} is over 2**52")
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], names=["vec_id", "x"])

    two = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return save(two.mapInArrow(run, "vec_id long, x array<long>"), name)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls, all lists of one length, as a matrix of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
