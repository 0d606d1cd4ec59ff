"""Pipeline stages on one input: each keeps the columns of documents and what it should not touch."""

from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from lodeseam.llm import common, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.save(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = docs.collect()
        now = {r.doc_id for r in rows}
        assert now <= before and len(rows) == len(now) and all(r.text is None or r.n_chars == len(r.text) for r in rows)
        if name == "line_dedup":
            assert now == before
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == before
    used = defaultdict(int)
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_pipeline_is_the_chain_of_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 10


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_with_odd_rows_and_clashing_columns(spark):
    """Nulls in every column, empty and very long texts, repeated rows and columns with names that operators use themselves."""
    long = " ".join(f"the {w}{k}" for k in range(30_000) for w in ("of", "and"))
    rows = [(1, long, "en", "s", len(long)), (None, None, None, None, None), (2, None, "en", "s", None), (3, "", "en", "s", 0), (4, long, None, None, len(long)), (4, long, None, None, len(long)), (None, long, "en", "s", len(long))]
    names = ["row", "fp", "k1", "h1", "drops", "items", "length", "sequence_id", "_lodeseam_drops"[1:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        docs = docs.withColumn(n, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.save(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.where(F.col("row") != "x").count() == 0
        ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect())
        if name == "quality_rules":  # null and empty texts go
            assert ids == [(False, 0), (True, 1), (True, 4), (True, 4)]
        elif name == "simhash_near_dedup":  # one of the long texts, one without a word
            assert ids == [(True, 1), (True, 2)]
        else:
            assert len(ids) == len(rows)
            assert sum(r.text is None for r in out.collect()) == 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)


def test_intermediate_tables_are_removed(spark):
    before = common.made()
    corpus_pipeline.run(spark, SF).count()
    left = common.made() - before
    assert len(left) <= 2  # what the last stage reads
    common.release(spark, before)
    assert common.made() == before
