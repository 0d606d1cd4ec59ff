"""Embedding whitening by LOBPCG: the leading eigenvectors of a covariance that is never formed.

Vectors stay where they are. A product of the covariance V with a block of m vectors is one pass: each task centres its
rows, multiplies them by the block and back, and adds up; the tasks' blocks, dimensions times m numbers each, are summed in
a shuffle. The driver holds blocks only: the iterate X, its residuals and the previous direction, over whose joint span
(at most 3m vectors) Rayleigh-Ritz picks the next X. Products of X and of the direction follow from those already made, so
a step makes one product, that of the residuals. Once those small residuals are seen, V X is made anew from the rows: the
residuals of that product, |V x - e x|, certify the eigenpairs (an eigenvalue of V lies within that distance of e).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, whole_numbers

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Extra vectors of the block; residuals to reach and to settle for, in parts of the largest eigenvalue; steps at most.
GUARD, FINE, ENOUGH, STEPS = 8, 1e-13, 1e-10, 500
#: A component with less than this part of the trace has no variance to divide by.
NONE = 1e-13


class Model(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimensions x components
    trace: float
    residual: float  # largest certified |V x - e x|
    steps: int
    identity_error: float | None

    @property
    def dims(self) -> int:
        return len(self.sums)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: whole numbers of the mean are subtracted as such, so that only its fraction is rounded."""
    return (x - np.array([s // n for s in sums], np.int64)).astype(np.float64) - np.array([(s % n) / n for s in sums])


def _added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], dims: int, size: int) -> np.ndarray:
    """Sum over all tasks of part(matrix of a batch), `size` numbers."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch.column(0), dims))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "v"])

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out


def product(rows: DataFrame, n: int, sums: list[int], block: np.ndarray) -> np.ndarray:
    """V block, by one pass over the rows."""
    dims, m = block.shape

    def part(x):
        c = centred(x, n, sums)
        return (c.T @ (c @ block)).ravel()

    return _added(rows, part, dims, dims * m).reshape(dims, m) / n


def _basis(block: np.ndarray, images: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Orthonormal columns with the same span, near dependent ones left out, and their images."""
    if not block.shape[1]:
        return block, images
    size = np.linalg.norm(block, axis=0)
    keep = size > 0
    block, size = block[:, keep] / size[keep], size[keep]
    u, s, vt = np.linalg.svd(block, full_matrices=False)
    good = s > 1e-8
    turn = vt[good].T / s[good]
    return block @ turn, None if images is None else (images[:, keep] / size) @ turn


def lobpcg(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(eigenvalues, eigenvectors, largest certified residual, steps) for the k largest eigenvalues of a symmetric matrix
    of which only its products with blocks are known."""
    m = min(dims, k + guard)
    x, _ = np.linalg.qr(np.random.default_rng(12).standard_normal((dims, m)))
    ax, fresh = times(x), True
    p = ap = np.zeros((dims, 0))
    best, stuck = np.inf, 0
    for step in range(STEPS):
        e, y = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        e, y = e[::-1], y[:, ::-1]
        x, ax = x @ y, ax @ y
        r = ax - x * e
        far = float(np.linalg.norm(r[:, :k], axis=0).max()) if k else 0.0
        stuck = stuck + 1 if far > best / 2 else 0
        best = min(best, far)
        if far <= FINE * abs(e[0]) or (stuck >= 4 and best <= ENOUGH * abs(e[0])):
            if fresh:
                return e[:k], x[:, :k], far, step
            x, _ = np.linalg.qr(x)
            ax, fresh = times(x), True  # from the rows, not from earlier products; the direction begins anew
            p = ap = np.zeros((dims, 0))
            continue
        w = r
        for _ in range(2):
            w = w - x @ (x.T @ w) - p @ (p.T @ w)
        w, _ = _basis(w)
        w = w - x @ (x.T @ w) - p @ (p.T @ w)
        w, _ = np.linalg.qr(w)
        if not w.shape[1]:  # the span holds all there is
            x, _ = np.linalg.qr(x)
            ax, fresh, stuck, best = times(x), True, 4, min(best, ENOUGH * abs(e[0]))
            continue
        s, a_s = np.hstack([x, p, w]), np.hstack([ax, ap, times(w)])
        e, y = np.linalg.eigh((s.T @ a_s + a_s.T @ s) / 2)
        y = y[:, ::-1][:, :m]
        p, ap = s[:, m:] @ y[m:], a_s[:, m:] @ y[m:]
        x, ax, fresh = s @ y, a_s @ y, False
        inside = x.T @ p
        p, ap = _basis(p - x @ inside, ap - ax @ inside)
        inside = x.T @ p
        p, ap = p - x @ inside, ap - ax @ inside
    raise RuntimeError(f"no certified eigenvectors after {STEPS} steps: residual {best}")


def fit(rows: DataFrame, dims: int, k: int = COMPONENTS) -> Model:
    """The first k components of (vec_id, x) rows, all of `dims` whole numbers; there must be rows."""

    def run(batches):
        total, n = [0] * dims, 0
        for batch in batches:
            x = matrix(batch.column(0), dims)
            if len(x):
                n += len(x)
                # halves, so that a batch of 52-bit numbers can't pass 63 bits
                low, high = (x & 0xFFFFFFFF).sum(axis=0).tolist(), (x >> 32).sum(axis=0).tolist()
                total = [t + a + (b << 32) for t, a, b in zip(total, low, high, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1, dtype=np.int32)), pa.array([*total, n], pa.decimal128(38, 0))], names=["at", "v"])

    told = {r["at"]: int(r.v) for r in rows.select("x").mapInArrow(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    n, sums = told[dims], [told[i] for i in range(dims)]
    trace = float(_added(rows, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]), dims, 1)[0] / n)
    values, vectors, residual, steps = lobpcg(lambda b: product(rows, n, sums, b), dims, min(k, dims))
    model = Model(n, sums, np.maximum(values, 0), vectors, trace, residual, steps, None)
    turn, live = _turn(model)
    c = int(live.sum())
    if not c:
        return model

    def moments(x):
        w = centred(x, n, sums) @ turn[:, live]
        return np.r_[(w.T @ w).ravel(), w.sum(axis=0)]

    got = _added(rows, moments, dims, c * c + c) / n
    return model._replace(identity_error=float(np.abs(got[: c * c].reshape(c, c) - np.outer(got[c * c :], got[c * c :]) - np.eye(c)).max()))


def _turn(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over the roots of their eigenvalues, and which have a variance to divide by."""
    live = model.values > NONE * model.trace
    return model.vectors / np.sqrt(np.where(live, model.values, 1)), live


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of (n x - S)^2 of each row, exactly."""
    apart = x - np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    largest = (int(np.abs(apart).max(initial=0)) + 1) * n
    if largest * largest * max(1, x.shape[1]) < 1 << 62:
        return pa.array(((n * apart - rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    return pa.array([sum((n * a - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in apart.tolist()], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each vector of `vectors` (vec_id, embedding) and each of its first k components: vec_id, component (from 1),
    n, deviation decimal (sum of (n x - S)^2, exact), whitened, explained, identity_error.

    An entry counts as floor(scale * entry) + shift. Rows go whose vector is null or has a null or non-finite entry; of
    vectors with several lengths those of the most frequent one are kept, at a tie of the longest. Fewer dimensions than k
    give fewer components. A component without variance (all rows equal there) has whitened null and explained 0, or null if
    nothing varies, when identity_error is null as well. Repeated rows and null vec_ids count like others; of components of
    equal variance any turn may come. A deviation of over 38 digits raises
    an error. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    numbers = whole_numbers(vectors, scale, shift, "whole_numbers")
    shape = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    length = numbers.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if length is None or not length.d:
        return vectors.sparkSession.createDataFrame([], shape)
    dims = length.d
    rows = numbers.where(F.size("x") == dims)
    model = fit(rows, dims, k)
    turn, live = _turn(model)
    n, sums, parts, error = model.n, model.sums, len(live), model.identity_error
    explained = [v / model.trace if model.trace else None for v in model.values.tolist()]

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), dims)
            w = centred(x, n, sums) @ turn
            at = pa.array(np.repeat(np.arange(len(x)), parts))
            columns = [
                batch.column(0).take(at),
                pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * parts, n, np.int64)),
                _deviation(x, n, sums).take(at),
                pa.array(w.ravel(), mask=np.tile(~live, len(x))),
                pa.array(explained * len(x), pa.float64()),
                pa.array([error] * (len(x) * parts), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, shape)
