import numpy as np
import pytest

from lodeseam.operators import vector, vector_index

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters of several widths, a third of all rows one vector, rows without a direction."""
    rng = np.random.default_rng(1)
    middles = rng.standard_normal((12, 16))
    rows = [(i, (middles[i % 12] + rng.standard_normal(16) * (0.1 + 0.05 * (i % 12))).tolist(), i % 3) for i in range(900)]
    rows += [(1000 + i, middles[0].tolist(), i % 3) for i in range(450)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] + [1.0] * 15, 0), (None, middles[3].tolist(), 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("vec_id % 20 = 0 AND vec_id < 1100").withColumnRenamed("vec_id", "qid").cache()


def brute(vectors, queries, k, scope=False):
    live = [(r.vec_id, np.array(r.embedding, float), r.label) for r in vectors.collect() if r.embedding is not None and np.isfinite(r.embedding).all() and any(r.embedding)]
    out = set()
    for q in queries.collect():
        e = np.array(q.embedding, float)
        near = [(-round(float(e @ v) / np.linalg.norm(e) / np.linalg.norm(v), 6), i is not None, i or 0) for i, v, s in live if not scope or s == q.label]
        out |= {(q.qid, i if there else None, rank + 1) for rank, (_, there, i) in enumerate(sorted(near)[:k])}
    return out


def rows(df):
    return {(r.qid, r.vec_id, r.vec_rank) for r in df.collect()}


@pytest.mark.parametrize("part", [20_000, 50])
def test_exact_equals_brute_force(vectors, queries, monkeypatch, part):
    monkeypatch.setattr(vector_index, "PART", part)
    index = vector_index.build(vectors, cells=20)
    assert index.vectors.count() == 1351
    assert rows(vector_index.exact(index, queries, 7, digits=6)) == brute(vectors, queries, 7)
    assert rows(vector_index.exact(index, queries, 7, probes=20, digits=6)) == brute(vectors, queries, 7)
    if part == 50:
        assert index.cells.agg({"parts": "max"}).first()[0] > 5


def test_scopes(vectors, queries):
    index = vector_index.build(vectors, scope="label")
    assert rows(vector_index.exact(index, queries, 5, digits=6)) == brute(vectors, queries, 5, True)
    assert rows(vector.top_k(queries, vectors.where("vec_id < 1500"), 5, scope="label", digits=6)) == brute(vectors.where("vec_id < 1500"), queries, 5, True)


def test_blocks_equal_brute_force(vectors, queries, monkeypatch):
    assert rows(vector.top_k(queries, vectors, 7, digits=6)) == brute(vectors, queries, 7)
    monkeypatch.setattr(vector_index, "MOST", 2000)
    assert rows(vector_index.by_blocks(queries, vectors, 3, digits=6)) == brute(vectors, queries, 3)


def test_probing_reaches_its_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    index = vector_index.build(v)
    n = vector_index.probes_for(index, q, 10, 0.9)
    assert n < index.k_cells and vector_index.recall(vector_index.search(index, q, 10, n), vector.top_k(q, v, 10)) >= 0.9


def test_clustered_vectors_need_few_cells(vectors, queries):
    index = vector_index.build(vectors, cells=24)
    true = vector_index.exact(index, queries, 10)
    assert vector_index.recall(vector_index.search(index, queries, 10, 6), true) >= 0.9
    assert vector_index.probes_for(index, queries, 10, 0.9) <= 6


def test_nothing(spark, vectors, queries):
    none = spark.createDataFrame([], SCHEMA)
    index = vector_index.build(none)
    assert vector_index.exact(index, queries).count() == vector_index.search(index, queries).count() == 0
    full = vector_index.build(vectors.limit(40))
    assert vector_index.search(full, none.withColumnRenamed("vec_id", "qid")).count() == 0
    assert vector.top_k(none.withColumnRenamed("vec_id", "qid"), vectors).count() == vector.top_k(queries, none).count() == 0


def test_no_loop_over_pairs(vectors, queries):
    index = vector_index.build(vectors)
    for df in (vector_index.exact(index, queries), vector_index.search(index, queries), vector.top_k(queries, vectors)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_products_of_a_block_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(5)
    near = np.round(rng.normal(size=(50, 300)), 1)  # many ties
    for k in (1, 7, 299, 300, 400):
        assert (vector_index._first_k(near, k) == np.argsort(-near, axis=1, kind="stable")[:, :k]).all()
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    q = v.withColumnRenamed("vec_id", "qid")
    monkeypatch.setattr(vector_index, "PRODUCTS", 1 << 22)
    whole = sorted(map(tuple, vector_index.by_blocks(q, v, 5, digits=3).collect()))
    captured = []
    real = type(v).mapInArrow
    monkeypatch.setattr(type(v), "mapInArrow", lambda self, f, *a, **kw: captured.append(f) or real(self, f, *a, **kw))
    vector_index.by_blocks(q, v, 5, digits=3)
    monkeypatch.setattr(vector_index, "PRODUCTS", 400 * 7)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([(np.array(e) / np.linalg.norm(e)).tolist() for _, e in rows])], names=["vec_id", "unit"])
    parts = list(captured[0]([batch]))
    assert len(parts) == -(-400 // 7) and max(p.num_rows for p in parts) <= 7 * 5
    got = [r for p in parts for r in zip(*(c.to_pylist() for c in p.columns), strict=True)]
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _, _ in whole}


def test_no_table_of_queries_and_cells(spark, vectors, queries, monkeypatch):
    """a query's cells are told from their centers where they lie; only the `probes` nearest are rows."""
    index = vector_index.build(vectors, cells=24)
    made = []
    real = vector_index.cut
    monkeypatch.setattr(vector_index, "cut", lambda df: made.append(real(df)) or made[-1])
    found = vector_index.exact(index, queries, 5, probes=2, digits=6)
    assert rows(found) == brute(vectors, queries, 5)
    assert max(df.count() for df in made) <= queries.count()
    assert "zip_with" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows_of_a_batch", [7, 10_000])
def test_scopes_are_products_too(spark, vectors, queries, monkeypatch, rows_of_a_batch):
    """with a scope, no row is made for a query and a vector; a task passes on k rows a query, however many batches it has."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_of_a_batch)
    try:
        found = vector.top_k(queries, vectors, 5, scope="label", digits=6)
        assert rows(found) == brute(vectors, queries, 5, True)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        units = vector_index._units(vectors.coalesce(1), "vec_id", "label")
        asked = vector_index.cut(vector_index._queries(queries, vectors, "label"))
        assert vector_index._scan(units, asked, 5, 6, "label").count() <= 5 * queries.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
