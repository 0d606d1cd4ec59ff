"""Centroid clustering: float32 screening with rigorous rounding-error intervals, exact integers where they overlap.

The squared distance of x and c without |x|^2 is |c|^2 - 2 x.c. A float32 matrix product gives x.c with an error of at most
gamma |x| |c|, whatever the order of its sums; so each centroid's score lies in a known interval. Centroids whose interval
begins above the smallest end of any are farther away for sure. Where one centroid is left it is the nearest; where several
are, their distances are worked out in whole numbers and the lowest number wins a tie. No result depends on rounding.

A round is one pass: tasks add up their vectors by centroid in whole numbers, and a shuffle of one row for each task,
centroid and dimension adds those up. The driver sees centroids only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .vectors import matrix, whole_numbers

CENTROIDS, ROUNDS, DIMS, SCALE, SALT = 40, 5, 64, 256, 2
#: Scores of one matrix product; bound of numbers whose squared differences are added up as 64-bit integers.
SCORES, SMALL = 1 << 20, 1 << 26


def screen(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of x, which rows of c can be the nearest by the intervals of their scores."""
    dims = x.shape[1]
    gamma = (dims + 4) * 2.0**-24 / (1 - (dims + 4) * 2.0**-24)  # roundings of both numbers, products and sums
    xd, cd = x.astype(np.float64), c.astype(np.float64)
    long_x, square_c = np.sqrt((xd * xd).sum(axis=1)), (cd * cd).sum(axis=1)
    dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    score = square_c - 2 * dot
    # twice the error of the product, and what the doubles themselves may have lost
    error = (2 * gamma * (1 + 2.0**-30)) * np.outer(long_x, np.sqrt(square_c)) + (square_c + 2 * np.abs(dot)) * 2.0**-46
    return score - error <= (score + error).min(axis=1, keepdims=True)


def exact_distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of equally many rows, as 64-bit integers or, for large numbers, as Python's."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) >= SMALL or x.shape[1] > 256:
        return ((x.astype(object) - c.astype(object)) ** 2).sum(axis=1)
    return ((x - c) ** 2).sum(axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of each row, and how many rows needed more than the screening."""
    picked, unsure = np.zeros(len(x), np.int64), 0
    block = max(1, SCORES // len(c))
    for at in range(0, len(x), block):
        rows = x[at : at + block]
        near = screen(rows, c)
        first = near.argmax(axis=1)
        several = np.flatnonzero(near.sum(axis=1) > 1)
        unsure += len(several)
        if len(several):
            row, j = np.nonzero(near[several])
            apart = exact_distance(rows[several[row]], c[j])
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(apart, starts)
            hit = np.flatnonzero(apart == least[row])
            hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # the first of a row has the lowest number
            first[several] = j[hit]
        picked[at : at + block] = first
    return picked, exact_distance(x, c[picked]), unsure


def _sums(points: DataFrame, centroids: np.ndarray, dims: int) -> dict[int, tuple[int, list[int]]]:
    """{centroid: (count, sums by dimension)} of the vectors that are nearest to each, exactly."""
    k = len(centroids)

    def run(batches):
        totals = np.zeros((k, dims + 1), object)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            picked, _, _ = nearest(x, centroids)
            order = np.argsort(picked, kind="stable")
            starts = np.flatnonzero(np.diff(picked[order], prepend=-1))
            if len(starts):
                wide = np.c_[x, np.ones(len(x), np.int64)][order]
                # Python's numbers where a batch of large ones could pass 63 bits
                part = np.add.reduceat(wide if np.abs(wide).max() < 1 << 40 else wide.astype(object), starts, axis=0)
                totals[picked[order][starts]] += part.astype(object)
        full = np.flatnonzero(totals[:, dims])
        cells = pa.array(np.repeat(full, dims + 1).astype(np.int32)), pa.array(np.tile(np.arange(dims + 1), len(full)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*cells, pa.array([int(v) for v in totals[full].ravel()], pa.decimal128(38, 0))], names=["cluster", "dim", "total"])

    added = points.select("x").mapInArrow(run, "cluster int, dim int, total decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("total").alias("total"))
    found: dict[int, list[int]] = {}
    for r in added.collect():  # centroids times dimensions
        found.setdefault(r.cluster, [0] * (dims + 1))[r.dim] = int(r.total)
    return {j: (v[dims], v[:dims]) for j, v in found.items()}


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: int = SALT) -> DataFrame:
    """One row a kept vector of `vectors` (vec_id, embedding): vec_id, cluster int, distance (squared), cluster_inertia and
    inertia long, centroid_sha256.

    Kept are vectors of exactly `dims` entries, none null or non-finite; an entry v counts as floor(scale * v). The first
    centroids are the k vectors with the smallest sha256 of `salt:vec_id`; each of `rounds` rounds replaces a centroid by the
    floor of its vectors' mean, and empty ones stay. A null vec_id is drawn last; rows of one vec_id are drawn in the order of
    their entries; equal centroids, like all ties, go to the lower number. With fewer than k vectors there are fewer
    centroids; an empty table, or one without a kept vector, gives no rows. Repeated rows all count. Other columns are
    ignored, whatever their names. Distances or inertias over 2**63 raise an error.
    """
    spark = vectors.sparkSession
    points = whole_numbers(vectors, scale, 0, "points").where(F.size("x") == dims)
    drawn = points.select("x", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    shape = "vec_id long, cluster int, distance long"
    if not drawn:
        return spark.createDataFrame([], shape + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.x for r in drawn], np.int64)
    for _ in range(rounds):
        for j, (n, sums) in _sums(points, centroids, dims).items():
            centroids[j] = [s // n for s in sums]

    def run(batches):
        for batch in batches:
            picked, apart, _ = nearest(matrix(batch.column(1), dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picked.astype(np.int32)), pa.array(apart.tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = save(points.mapInArrow(run, shape), "assigned")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    digest = {j: hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest() for j in inertia}
    told = spark.createDataFrame([(j, s, sum(inertia.values()), digest[j]) for j, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
