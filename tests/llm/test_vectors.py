"""Centroid clustering and whitening against plain versions of their contracts."""

import hashlib
import math
from decimal import Decimal

import numpy as np
import pytest

from lodeseam.llm import centroids, queries, whitening
from lodeseam.llm.vectors import whole_numbers

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def plain_clusters(rows, k, rounds, dims, scale, salt):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) by Python's whole numbers alone."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    drawn = sorted(kept, key=lambda r: ((r[0] is None), hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    middle = [list(x) for _, x in drawn]

    def assign():
        out = []
        for _, x in kept:
            apart = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in middle]
            out.append((apart.index(min(apart)), min(apart)))
        return out

    for _ in range(rounds):
        groups = {}
        for (_, x), (j, _) in zip(kept, assign(), strict=True):
            groups.setdefault(j, []).append(x)
        for j, g in groups.items():
            middle[j] = [sum(col) // len(g) for col in zip(*g, strict=True)]
    last = assign()
    inertia = {}
    for j, d in last:
        inertia[j] = inertia.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return [(i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (j, d) in zip(kept, last, strict=True)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def odd_vectors(dims=4):
    """Nulls, other lengths, repeated rows, one id twice, many copies of one vector, ties between centroids."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, dims) / 4]) for k in range(60)]
    rows += [(100, None), (101, [0.5] * (dims - 1)), (102, []), (103, [0.5, None, 0.5, 0.5]), (104, [float("nan")] * dims), (105, [float("inf")] + [0.0] * (dims - 1)), (None, [0.25] * dims), (None, [-0.5] * dims)]
    return rows + [rows[5], rows[5], (5, [9.0] * dims)] + [(200 + k, [0.75] * dims) for k in range(40)]


@pytest.mark.parametrize(("k", "rounds"), [(7, 3), (1, 1), (500, 2)])
def test_clusters_of_odd_rows(spark, k, rounds):
    rows = odd_vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA + ", x string, cluster int")
    got = centroids.cluster(df, k=k, rounds=rounds, dims=4, scale=4, salt=9)
    assert ordered(tuple(r) for r in got.collect()) == ordered(plain_clusters(rows, k, rounds, 4, 4, 9))


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        got = centroids.cluster(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_op11(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert ordered(tuple(r) for r in queries.op11_centroid_clustering(spark, SF).collect()) == ordered(plain_clusters(rows, 40, 5, 64, 256, 2))


@pytest.mark.parametrize("size", [3, 300, 30_000, 1 << 25, 1 << 27, 1 << 41])
def test_nearest_where_float32_cannot_tell(size):
    """Distances that differ by one, or not at all, at all magnitudes; int64 can't hold the largest ones."""
    rng = np.random.default_rng(size)
    base = rng.integers(-size, size + 1, 16)
    c = np.array([base + rng.integers(-1, 2, 16) for _ in range(30)] + [base, base])
    x = np.array([base + rng.integers(-2, 3, 16) for _ in range(200)])
    picked, apart, unsure = centroids.nearest(x, c)
    want = [[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in c.tolist()] for p in x.tolist()]
    assert picked.tolist() == [w.index(min(w)) for w in want] and [int(a) for a in apart] == [min(w) for w in want]
    assert unsure > 0


def test_screening_leaves_few_rows():
    rng = np.random.default_rng(5)
    x, c = rng.integers(-120, 120, (2000, 64)), rng.integers(-60, 60, (40, 64))
    assert centroids.nearest(x, c)[2] < 20
    near = centroids.screen(x, c)
    exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert near[np.arange(len(x)), exact.argmin(axis=1)].all()


def matrix_of(rng, dims, gap):
    q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    return (q * np.array([10.0 - gap * k for k in range(dims)])) @ q.T


@pytest.mark.parametrize(("dims", "k", "gap"), [(3, 8, 1.0), (12, 8, 0.5), (64, 8, 0.1), (64, 8, 0.001), (200, 8, 0.01), (200, 5, 0.0)])
def test_lobpcg_against_dense_eigenvectors(dims, k, gap):
    a = matrix_of(np.random.default_rng(dims), dims, gap)
    e, x, residual, steps = whitening.lobpcg(lambda b: a @ b, dims, min(k, dims))
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1][: len(e)], rtol=1e-12) and residual < 1e-9 and steps < 200
    assert np.abs(a @ x - x * e).max() < 1e-9 and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12


def test_lobpcg_of_matrices_without_full_rank():
    for rank in (0, 1, 5):
        v = np.random.default_rng(rank).standard_normal((30, rank))
        e, x, _, _ = whitening.lobpcg(lambda b, v=v: v @ (v.T @ b), 30, 8)
        assert np.allclose(e, np.r_[np.linalg.svd(v)[1] ** 2, np.zeros(8 - rank)], atol=1e-9) and np.abs(x.T @ x - np.eye(8)).max() < 1e-12


def plain_whitening(rows, k=8):
    """x, covariance, S and the exact deviations of the remaining rows, by numpy's dense eigenvectors."""
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x, n = np.array([v for _, v in kept], float), len(kept)
    sums = [sum(c) for c in zip(*[v for _, v in kept], strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for _, v in kept]
    c = x - np.array(sums) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return kept, c, e[::-1][:k], u[:, ::-1][:, :k], deviation, e.sum()


def test_op12(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    kept, c, e, u, deviation, trace = plain_whitening(rows)
    got = queries.op12_embedding_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    got = {(r.vec_id, r.component): r for r in got.collect()}
    assert set(got) == {(i, j) for i, _ in kept for j in range(1, 9)}
    for j in range(8):
        mine, want = np.array([got[i, j + 1].whitened for i, _ in kept]), c @ u[:, j] / np.sqrt(e[j])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        assert abs(got[kept[0][0], j + 1].explained - e[j] / trace) < 1e-12
    assert [got[i, 1].deviation for i, _ in kept] == deviation
    assert {r.n for r in got.values()} == {len(kept)} and max(r.identity_error for r in got.values()) < 1e-9


def test_whitening_of_odd_rows(spark):
    rows = [r for r in odd_vectors(9)] + [(7, [0.125 * k for k in range(9)])] * 3
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA + ", component int")
    kept, c, e, u, deviation, trace = plain_whitening([r for r in rows if r[1] is not None and len(r[1]) == 9])
    got = whitening.whiten(df, k=3).collect()
    assert len(got) == 3 * len(kept)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(map(Decimal, deviation))
    assert sum(r.vec_id is None for r in got) == 6
    first = sorted(abs(r.whitened) for r in got if r.component == 1)
    assert np.allclose(first, sorted(np.abs(c @ u[:, 0] / np.sqrt(e[0]))), atol=1e-9)


def test_whitening_without_variance(spark):
    shape = lambda rows, **k: [(r.vec_id, r.component, r.whitened, r.explained, r.identity_error, r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA), **k).collect()]
    assert shape([]) == [] and shape([(1, None), (2, [None])]) == [] and shape([(1, [])]) == []
    assert shape([(1, [0.5, 1.0])]) == [(1, 1, None, None, None, 0), (1, 2, None, None, None, 0)]
    flat = sorted(shape([(1, [0.0, 1.0]), (2, [1.0, 1.0])]))
    assert [r[1:3] for r in flat][1::2] == [(2, None)] * 2 and abs(flat[0][2]) == pytest.approx(1) and flat[0][3] == pytest.approx(1) and flat[1][3] == pytest.approx(0)


def test_deviation_beyond_64_bits():
    x, n = np.array([[1 << 30, 0], [3, -(1 << 40)]]), 10**6
    sums = [(1 << 30) + 3, -(1 << 40)]
    assert whitening._deviation(x, n, sums).to_pylist() == [Decimal(sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))) for r in x.tolist()]


def test_entries_too_large(spark):
    with pytest.raises(Exception, match="over 2"):
        whole_numbers(spark.createDataFrame([(1, [1e30])], SCHEMA), 256, 0, "x").count()
