"""Blocks of chunks, and what a ranked search makes of them."""

import random

import pytest
from pyspark.sql import functions as F

from lodeseam.operators import blocks, postings, search
from lodeseam.sources.index_store import IndexStore

SCHEMA = "domain string, doc_id string, chunk_id string, text string, has_table boolean"


def table(spark, n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    # every third text is one of few, so that scores tie
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40]))) for _ in range(n)]
    return spark.createDataFrame([(f"d{k % 2}", f"doc{k % 7}", f"c{k}", texts[k % 5] if k % 3 == 0 else texts[k], False) for k in range(n)], SCHEMA)


def ranked(found):
    return sorted(map(tuple, found.select("qid", "doc_id", "chunk_id", "bm25", "rank").collect()))


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(f"q{k}", f"d{k % 2}", " ".join(f"w{rng.randrange(40)}" for _ in range(6)), ["doc1", "doc2"] if k % 4 == 0 else None) for k in range(9)], "qid string, domain string, question string, doc_ids array<string>")


def test_blocks_hold_all_counts(spark):
    chunks = table(spark, 100)
    made = blocks.made(chunks.repartition(3))
    rows = made.collect()
    assert len({r.block for r in rows}) == len(rows) and all(1 <= len(r.chunks) <= blocks.BLOCK for r in rows)
    for t, r in ((t, r) for r in rows for t in r.terms):
        items = t["items"]
        assert t.df == len(items) and t.most == max(i.tf for i in items) and t.least == min(r.chunks[i.place].n_terms for i in items)
    got = sorted((r.chunks[i.place].chunk_id, t.term, i.tf) for r in rows for t in r.terms for i in t["items"])
    assert got == sorted(map(tuple, postings.term_frequency(chunks).select("chunk_id", "term", "tf").collect()))


@pytest.mark.parametrize("cells, pairs", [(blocks.CELLS, blocks.PAIRS), (1, 1)])
def test_ranks_are_those_of_all_scores(spark, asked, tmp_path, monkeypatch, cells, pairs):
    """Whatever a step holds, with ties, deletions and questions about documents."""
    scorer = blocks._scorer

    def small_steps(*a):
        def run(batches, go=scorer(*a)):
            blocks.CELLS, blocks.PAIRS = cells, pairs
            return go(batches)

        return run

    monkeypatch.setattr(blocks, "_scorer", small_steps)
    chunks = table(spark, 150)
    store = IndexStore(spark, str(tmp_path / "index"))
    store.append(chunks)
    store.delete(chunks.where("doc_id = 'doc3'"))
    scored = search.bm25(chunks.where("doc_id <> 'doc3'"), asked, synonyms={}).withColumn("bm25", F.round("bm25", 6))
    assert ranked(store.top_k(asked, 4, synonyms={}, digits=6)) == ranked(search.top_k(scored, 4, "bm25"))


def _shuffles(found):
    return found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_only_first_chunks_are_shuffled(spark, asked, tmp_path):
    """Hits of questions and chunks, and bounds of questions and blocks, are no rows: the one shuffle is of what the tasks found."""
    store = IndexStore(spark, str(tmp_path / "index"))
    store.append(table(spark, 400))
    found = store.top_k(asked, 4, synonyms={}, digits=6)
    assert _shuffles(found) == 1


def test_a_deletion_counts_terms_without_writing_a_row_for_each_chunk(spark, tmp_path, monkeypatch):
    from lodeseam.sources import index_store

    written, cut = [], index_store.cut
    store, chunks = IndexStore(spark, str(tmp_path / "index")), table(spark, 60)
    store.append(chunks)
    monkeypatch.setattr(index_store, "cut", lambda df: written.append(df.columns) or cut(df))
    store.delete(chunks.where("doc_id = 'doc3'"))
    assert written and all("chunk_id" not in c for c in written)
    left = search.idf(postings.term_frequency(chunks.where("doc_id <> 'doc3'")))
    assert sorted((r.domain, r.term, r.df) for r in store.tables()["terms"].collect()) == sorted((r.domain, r.term, r.df) for r in left.collect())
