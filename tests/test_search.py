import re

import math

from pyspark.sql import functions as F

from lodeseam.operators import postings, search

CHUNK = "domain string, doc_id string, chunk_id string, chunk_no int, text string, has_table boolean, page int"


def corpus(spark):
    rows = [("d", "a", "a1", 0, "apple pear apple", False, 1), ("d", "a", "a2", 1, "pear plum", False, 1), ("d", "b", "b1", 0, "fig grape 12.5", True, 1), ("d", "b", "b2", 1, "apple fig quince", False, 1), ("e", "c", "c1", 0, "apple", False, 1)]
    return spark.createDataFrame(rows, CHUNK)


def test_bm25_by_hand_and_scope_keeps_corpus_statistics(spark):
    docs = {"a1": "apple pear apple".split(), "a2": "pear plum".split(), "b1": "fig grape 12.5".split(), "b2": "apple fig quince".split()}
    n, mean = 4, sum(map(len, docs.values())) / 4
    df = {t: sum(t in w for w in docs.values()) for w in docs.values() for t in w}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    idf = {t: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, r in raw.items()}

    def score(c):
        w = docs[c]
        return sum(idf[t] * w.count(t) * 2.8 / (w.count(t) + 1.8 * (0.4 + 0.6 * len(w) / mean)) for t in ("apple", "grape", "grape"))

    q = spark.createDataFrame([("1", "d", "apple grape grape", None), ("2", "d", "apple grape grape", ["b"])], "qid string, domain string, question string, doc_ids array<string>")
    got = {(r.qid, r.chunk_id): r.bm25 for r in search.bm25(corpus(spark), q, synonyms={}).collect()}
    assert set(got) == {("1", "a1"), ("1", "b1"), ("1", "b2"), ("2", "b1"), ("2", "b2")}
    for (_, c), x in got.items():
        assert abs(x - score(c)) < 1e-9


def scored(spark, rows):
    return spark.createDataFrame(rows, "qid string, doc_id string, chunk_id string, has_table boolean, score double")


def questions(spark, docs):
    return spark.createDataFrame([("1", docs)], "qid string, doc_ids array<string>")


def chosen(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


def test_quota_first_then_fill(spark):
    df = scored(spark, [("1", "a", f"a{k}", False, 10.0 - k) for k in range(6)] + [("1", "b", "b0", False, 1.0)])
    assert chosen(search.select(df, questions(spark, ["a", "b"]), 6)) == ["a0", "a1", "a2", "b0", "a3", "a4"]
    assert chosen(search.select(df, questions(spark, ["a"]), 3)) == ["a0", "a1", "a2"]


def test_table_takes_the_last_place_and_a_vector_hit_evicts_it(spark):
    df = scored(spark, [("1", "a", f"a{k}", k >= 4, 10.0 - k) for k in range(6)])
    assert chosen(search.select(df, questions(spark, None), 3)) == ["a0", "a1", "a4"]
    vectors = spark.createDataFrame([("1", "a0", 1), ("1", "a5", 2)], "qid string, chunk_id string, vec_rank int")
    assert chosen(search.select(df, questions(spark, None), 3, vectors=vectors)) == ["a0", "a1", "a5"]


def test_ties_are_broken_by_document_and_chunk(spark):
    df = scored(spark, [("1", "b", "x", False, 1.0), ("1", "a", "z", False, 1.0), ("1", "a", "y", False, 1.0)])
    assert chosen(search.top_k(df, 2)) == ["y", "z"]


def test_numeric_boost_needs_context_and_converts_units(spark):
    rows = [("financial_reports", "a", "a1", 0, "营业收入 37,448 百万元", False, 1), ("financial_reports", "a", "a2", 1, "其他 37,448", False, 1), ("financial_reports", "a", "a3", 2, "表 5678", True, 1)]
    chunks = spark.createDataFrame(rows, CHUNK)
    q = spark.createDataFrame([("1", "financial_reports", "营业收入是374.48亿元吗", {"A": "5678"})], "qid string, domain string, question string, options map<string,string>")
    got = {r.chunk_id: r.numeric for r in search.numeric_boost(chunks, q).collect()}
    assert got["a1"] == 15.0 and got.get("a2", 0.0) == 0.0 and got["a3"] == 250.0


def test_phrase_and_entity_boosts(spark):
    chunks = spark.createDataFrame([("financial_reports", "a", "a1", 0, "研发投入合计，比亚迪集团", False, 1), ("financial_reports", "a", "a2", 1, "无", False, 1)], CHUNK)
    q = spark.createDataFrame([("1", "financial_reports", "研发投入合计", {"A": "比亚迪集团"})], "qid string, domain string, question string, options map<string,string>")
    got = {r.chunk_id: r.phrase for r in search.phrase_boost(chunks, q).collect()}
    assert got == {"a1": 10.0 + 40.0 + 40.0 + 10.0}
    assert [r.entity for r in search.entity_boost(chunks, q).collect()] == [5.0]
    assert [round(r.phrase, 6) for r in search.phrase_boost(chunks, q, by_domain=False).collect()] == [0.95]


def test_whole_search_adds_up(spark):
    q = spark.createDataFrame([("1", "d", "apple fig", {"A": "grape"}, ["a", "b"])], "qid string, domain string, question string, options map<string,string>, doc_ids array<string>")
    rows = search.search(corpus(spark), q, 3).collect()
    assert 0 < len(rows) <= 3
    for r in rows:
        assert abs(r.score - (r.bm25 + r.numeric + r.phrase + r.entity + r.table_boost)) < 1e-9


def test_empty_corpus_and_no_terms(spark):
    q = spark.createDataFrame([("1", "d", "")], "qid string, domain string, question string")
    assert search.bm25(corpus(spark), q).count() == 0
    assert search.bm25(corpus(spark).limit(0), q).count() == 0


def test_symbol_weights(spark):
    chunks = spark.createDataFrame([("d", "a", "a1", 0, "营业收入2024年 第三条", True, 1)], CHUNK)
    got = {(r.family, r.symbol): round(r.weight, 4) for r in postings.symbols(chunks).collect()}
    assert got[("metric", "营业收入")] == 1.95 and got[("clause", "第三条")] == 1.56 and got[("table", "a")] == 1.5
    assert postings.stats(postings.symbols(chunks)).where(F.col("family") == "table").first().total_entries == 1


def test_boosts_are_summed_where_chunks_lie(spark):
    from lodeseam.plans import queries

    plan = queries.QUERIES["cjk_domain_boosts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plain = re.sub(r"#[0-9]+L?", "", plan)
    # chunks are dealt once for each of the three boosts, and neither hits nor texts are shuffled
    assert "hashpartitioning(doc_id, chunk_id" in plain and "hashpartitioning(qid" not in plain


def test_words_of_a_question_are_counted_in_its_row(spark):
    q = spark.createDataFrame([("1", "d", "alpha beta alpha", {"A": "beta 3.5", "B": "alpha"}), ("2", "d", "", {}), ("3", "d", None, None)], "qid string, domain string, question string, options map<string,string>")
    terms = search.query_terms(q, {})
    assert {(r.qid, r.term): r.times for r in terms.collect()} == {("1", "alpha"): 3, ("1", "beta"): 2, ("1", "3.5"): 1}
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
