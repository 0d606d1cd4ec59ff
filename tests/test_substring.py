import random

import pytest

from lodeseam.operators import evalset, substring, tools

SCHEMA = "domain string, doc_id string, chunk_id string, text string"
PHRASES = ["the", "aaa", "aa", "a", "🎉", "日本", "日本語の", "", None, "zebra crossing", "nowhere at all", "ab\nab", "é", "the the", "x\x00y", "🎉🎉🎉"]


def texts():
    rng = random.Random(2)
    parts = ["the ", "aaaa", "ab\n", "🎉", "日本語", "のは", "é", " zebra crossing ", "x\x00y", "b", ""]
    out = [("d", f"doc{k % 3}", f"c{k}", "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 40])))) for k in range(60)]
    return [*out, ("d", None, "n1", "the end"), ("d", "doc1", None, "日本語の"), ("d", "doc1", "n2", None), ("d", "doc1", "long", "aab" * 30_000), *[("d", "hot", f"h{k}", "the hot passage") for k in range(40)]]


def brute(rows, phrases):
    out = []
    for _, d, c, t in rows:
        for k, p in enumerate(phrases):
            at = [i for i in range(len(t or "")) if p and t.startswith(p, i)]
            if at:
                out.append((str(k), str(d), str(c), tuple(at)))
    return sorted(out)


def got(df):
    return sorted((r.qid, str(r.doc_id), str(r.chunk_id), tuple(r["at"])) for r in df.collect())


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(str(k), p) for k, p in enumerate(PHRASES)], "qid string, phrase string")


@pytest.mark.parametrize("most", [None, 900])
def test_within(chunks, queries, monkeypatch, most):
    if most:
        monkeypatch.setattr(substring, "MOST", most)
    assert got(substring.within(queries, chunks)) == brute(texts(), PHRASES)


def test_find_by_postings(spark, chunks, queries, tmp_path):
    want = brute([r for r in texts() if r[1] and r[2]], PHRASES)
    index = substring.build(chunks, str(tmp_path / "grams"))
    assert got(substring.find(index, queries, chunks)) == want
    again = substring.load(spark, str(tmp_path / "grams"))
    assert got(substring.find(again, queries, chunks)) == want
    plan = substring.find(again, queries, chunks)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing(spark, chunks, queries):
    none = spark.createDataFrame([], SCHEMA)
    assert substring.within(queries, none).count() == 0 and substring.find(substring.build(none), queries, none).count() == 0
    assert substring.within(queries.limit(0), chunks).count() == 0


def test_anchor_chunks_are_anchor_in_text(spark, chunks):
    from pyspark.sql import functions as F

    anchors = ["the", "1,234.5", "1234.5;aaaa;zebra", "zebra crossing ; nowhere", "日本；のは；é", "", None, ",;the", "a;b;c;d", "nowhere;never"]
    items = spark.createDataFrame([(str(k), a) for k, a in enumerate(anchors)], "qid string, anchor string")
    more = spark.createDataFrame([("d", "m", "m1", "has 1234.5 here"), ("d", "m", "m2", "has 1,234.5 here")], SCHEMA)
    held = chunks.unionByName(more).where("chunk_id IS NOT NULL").cache()
    for but in (0, 1):
        want = held.crossJoin(items).where(evalset.anchor_in_text(F.col("anchor"), F.col("text"), but)).select("qid", "chunk_id")
        mine = evalset.anchor_chunks(items, held, but).select("qid", "chunk_id")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, want.collect()))


def test_tools_have_no_loop_over_pairs(spark, chunks, queries):
    q = queries.select("qid", "phrase").where("phrase != ''")
    keys = chunks.selectExpr("domain", "doc_id", "chunk_id", "concat('key ', chunk_id) AS key")
    plans = [tools.search_phrase(q, keys, chunks), tools.fulltext(chunks, q.withColumnRenamed("phrase", "keyword")), evalset.anchor_chunks(q.withColumnRenamed("phrase", "anchor"), chunks)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.stage for r in plans[0].collect()} <= {0, 1, 2}


def test_an_index_for_one_call_is_written_without_a_shuffle(spark, chunks, queries, monkeypatch):
    wrote, cut = [], substring.cut
    monkeypatch.setattr(substring, "cut", lambda df, **options: (wrote.append(df), cut(df, **options))[1])
    monkeypatch.setattr(substring, "STEP", 1 << 12)  # pieces of a few texts
    index = substring.build(spark.createDataFrame(texts(), SCHEMA).repartition(12))
    plan = wrote[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan  # the repartition of the test
    assert got(substring.find(index, queries, chunks)) == brute([r for r in texts() if r[1] and r[2]], PHRASES)
