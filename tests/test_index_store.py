import random

import pytest
from pyspark.sql import functions as F

from lodeseam.operators import postings, search
from lodeseam.sources.index_store import IndexStore

SCHEMA = "domain string, doc_id string, chunk_id string, text string, has_table boolean"


def rows(seed, n, docs=5, first=0):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["资产", "12.5%", "《公司法》"]
    text = lambda: " ".join(rng.choice(words[: rng.choice([8, 63])]) for _ in range(rng.choice([0, 3, 20, 90])))
    return [(f"d{k % 2}", f"doc{first + k % docs}", f"c{seed}-{k}", text() or None, False) for k in range(n)]


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(9)
    qs = [(f"q{k}", f"d{k % 2}", " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 4, 12]))), None if k % 3 else ["doc1", "doc7"]) for k in range(12)]
    return spark.createDataFrame([*qs, ("none", "d0", "absent words", None), ("other", "nowhere", "w1", None), ("empty", "d0", "", None)], "qid string, domain string, question string, doc_ids array<string>")


def plain(chunks, questions, k):
    scored = search.bm25(chunks, questions, synonyms={}).withColumn("bm25", F.round("bm25", 6))
    return sorted(map(tuple, search.top_k(scored, k, "bm25").select("qid", "doc_id", "chunk_id", "bm25", "rank").collect()))


def stored(store, questions, k, **how):
    return sorted(map(tuple, store.top_k(questions, k, synonyms={}, digits=6, **how).select("qid", "doc_id", "chunk_id", "bm25", "rank").collect()))


def test_changes_give_the_ranks_of_an_index_made_anew(spark, questions, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    table = lambda r: spark.createDataFrame(r, SCHEMA)
    assert stored(store, questions, 3) == [] and store.version()["number"] == 0
    first, second = rows(1, 90), rows(2, 60, 4, 3)
    store.append(table(first))
    assert stored(store, questions, 5) == plain(table(first), questions, 5)
    store.append(table(second))
    assert stored(store, questions, 5) == plain(table(first + second), questions, 5)
    store.delete(table([("d0", "doc3", "", "", False), ("d1", "doc3", "", "", False), ("d0", "none", "", "", False)]))
    left = [r for r in first + second if r[1] != "doc3"]
    assert stored(store, questions, 5) == plain(table(left), questions, 5)
    third = rows(3, 30, 2, 3)  # brings doc3 back
    store.append(table(third))
    store.delete(table([("d0", "doc3", "", "", False)]).limit(0))
    assert stored(store, questions, 4) == plain(table(left + third), questions, 4)
    n = store.chunks().count()
    store.compact()
    assert store.version()["deletions"] == [] and len(store.version()["segments"]) == 1 and store.chunks().count() == n == len(left + third)
    assert stored(store, questions, 4) == plain(table(left + third), questions, 4)
    got = store.tables()
    for family, make in (("numbers", postings.numeric), ("phrases", postings.phrase), ("entities", postings.entity)):
        assert sorted(map(tuple, got[family].collect())) == sorted(map(tuple, make(table(left + third)).select("domain", "doc_id", "chunk_id", "key").collect()))
    mine, anew = (sorted((r.term, r.df, round(r.idf, 9), round(r.mean_terms, 9)) for r in t.collect()) for t in (got["terms"], search.idf(postings.term_frequency(table(left + third)))))
    assert mine == anew


def test_half_of_the_blocks_stay_unread(spark, tmp_path):
    from lodeseam.plans.registry import chunks_of, questions_of

    sf = "/root/testdata/sf0.1"
    store = IndexStore(spark, str(tmp_path / "index"))
    store.append(chunks_of(spark, sf))
    read = []
    assert store.top_k(questions_of(spark, "/root/testdata/sf0.001"), 10, synonyms={}, digits=6, read=read).count() == 400
    blocks, seen = read[0].agg(F.sum("blocks"), F.sum("blocks_read")).first()
    print(f"blocks {blocks}, read {seen}")
    assert seen < 0.3 * blocks


def test_two_writers_of_one_version(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.append(spark.createDataFrame(rows(1, 5), SCHEMA))
    before = store.version()
    store._commit(before, before["segments"], [])
    with pytest.raises(RuntimeError):
        store._commit(before, before["segments"], [])
