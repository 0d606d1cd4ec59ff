from pyspark.sql import functions as F

from lodeseam.operators import entities, evalset, graph, postings, tools, vector
from lodeseam.sources import ingest, keyed, sinks
from lodeseam.streaming import ingest as stream

CHUNK = "domain string, doc_id string, chunk_id string, chunk_no int, text string, has_table boolean, page int"


def chunks(spark):
    return spark.createDataFrame([("d", "a", "a1", 0, "营业收入，10亿元", False, 1), ("d", "a", "a2", 1, "收入共1,234万元", False, 1), ("d", "b", "b1", 0, "净利润，营业收入", False, 1)], CHUNK)


def hits(df):
    return [(r.qid, r.chunk_id, r.stage) for r in df.orderBy("qid", "rank").collect()]


def test_occurrences_and_windows(spark):
    df = spark.createDataFrame([("abXcdXefYgh" + "-" * 50 + "X",)], "t string")
    assert df.select(tools.occurrences(F.col("t"), F.lit("X"))).first()[0] == [2, 5, 61]
    assert df.select(tools.occurrences(F.lit("aaaa"), F.lit("aa"))).first()[0] == [0, 2]
    assert df.select(tools.occurrences(F.col("t"), F.lit(""))).first()[0] == []
    got = df.select(tools.windows(F.col("t"), F.array(F.lit("X"), F.lit("Y")), 12).alias("w")).first().w
    assert [(s.position, s.match_count) for s in got] == [(0, 2), (57, 1)]


def test_number_cascade(spark):
    c = chunks(spark)
    q = spark.createDataFrame([("1", "10", "亿元"), ("2", "1,234", ""), ("3", "999", "")], "qid string, number string, unit string")
    assert hits(tools.search_number(q, postings.numeric(c), c)) == [("1", "a1", 0), ("2", "a2", 0)]


def test_phrase_and_keyword_cascades(spark):
    c = chunks(spark)
    p = postings.phrase(c)
    q = spark.createDataFrame([("1", "营业收入"), ("2", "收入共")], "qid string, phrase string")
    assert hits(tools.search_phrase(q, p, c)) == [("1", "a1", 0), ("1", "b1", 0), ("2", "a2", 0)] or ("2", "a2", 1) in hits(tools.search_phrase(q, p, c))
    k = spark.createDataFrame([("1", ["营业收入", "净利润"]), ("2", ["收入", "没有"])], "qid string, words array<string>")
    got = [(r.qid, r.chunk_id, r.stage, r.hits) for r in tools.search_keyword(k, p, c).orderBy("qid", "rank").collect()]
    assert got[0] == ("1", "b1", 0, 2) and {x[2] for x in got if x[0] == "2"} == {2}


def test_merges(spark):
    a = spark.createDataFrame([("1", "d", "x", 1.0)], "qid string, doc_id string, chunk_id string, score double")
    b = spark.createDataFrame([("1", "d", "x", 9.0), ("1", "d", "y", 5.0)], "qid string, doc_id string, chunk_id string, score double")
    assert [(r.chunk_id, r.score) for r in tools.merge_first_seen([a, b]).orderBy("rank").collect()] == [("y", 5.0), ("x", 1.0)]
    s = spark.createDataFrame([("1", "same text", 3), ("1", "other", 1)], "qid string, text string, match_count int")
    assert tools.merge_by_prefix([s, s], [1, 5], 4).count() == 2


def test_option_hits(spark):
    df = spark.createDataFrame([("总营业收入增长；营业收入 1,234", "营业收入")], "t string, o string")
    h = df.select(tools.option_hits(F.col("t"), F.col("o")).alias("h"), tools.option_support(tools.option_hits(F.col("t"), F.col("o"))).alias("s")).first()
    assert h.h.whole == 2 and h.h.independent == 1 and h.s == "whole"


def test_graph(spark):
    c = chunks(spark)
    e = graph.edges(c, postings.entity(c))
    assert {(r.src, r.dst) for r in e.where("relation = 'next_chunk'").collect()} == {("a1", "a2")}
    starts = spark.createDataFrame([("1", "a1", 1.0)], "qid string, chunk_id string, score double")
    seq = e.where("relation like '%_chunk'").select("src", "dst")
    assert {(r.chunk_id, r.depth) for r in graph.expand(starts, seq, 2).collect()} == {("a1", 0), ("a2", 1)}
    assert {r.chunk_id: round(r.score, 2) for r in graph.spread(starts, seq).collect()} == {"a1": 1.0, "a2": 0.8}
    assert graph.fuse(starts, starts).first().score == 1.0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    q = spark.createDataFrame([(9, [2.0, 0.0], 0)], "qid long, embedding array<double>, label int")
    assert [r.vec_id for r in vector.top_k(q, v, 1).collect()] == [1]
    assert {r.vec_id for r in vector.top_k(q, v, 5, scope="label").collect()} == {1, 2}


def test_metric_pairs_and_items(spark):
    t = "比亚迪2024年营业收入为1,234.5万元。净利润约56万元；2023年"
    c = spark.createDataFrame([("d", f"doc{k}", f"c{k}", 0, t.replace("56", str(56 + k)), False, 1) for k in range(3)], CHUNK)
    p = evalset.metric_pairs(c, entities=("比亚迪",))
    rows = p.where("chunk_id = 'c0'").orderBy("pos").collect()
    assert [(r.metric, r.num_core, r.unit, r.entity) for r in rows] == [("营业收入", "1,234.5", "万元", "比亚迪"), ("净利润", "56", "万元", "")]
    items = evalset.single_hop(p)
    assert items.count() == 6 and all(r.options["ABCD".index(r.gold_answer)] in ("1,234.5", "56", "57", "58") and len(set(r.options)) == 4 for r in items.collect())
    assert evalset.multi_hop(p).where("size(gold_chunk_ids) = 2").count() == 1
    assert evalset.quality(items, c).where("reason = ''").count() == 6
    assert evalset.calc(p, c).count() > 0 and evalset.logical_compare(p).count() == 3
    assert evalset.stratified(items, {"single_hop": 2}).count() == 2
    assert evalset.shares(10, {"a": 0.35, "b": 0.65}) == {"a": 4, "b": 6}


def test_rule_items(spark):
    c = spark.createDataFrame([("d", "x", "c", 0, "注册资本不低于5000万元", False, 1)], CHUNK)
    r = evalset.logical_rule(c).first()
    assert r.options["ABCD".index(r.gold_answer)] == "注册资本不低于5000万元" and "注册资本不高于5000万元" in r.options


def test_ambiguous_alias_is_dropped(spark):
    rows = spark.createDataFrame([("甲乙丙、丁戊己", "| 指 | 甲乙丙公司"), ("甲乙丙", "| 指 | 另一公司")], "alias_list string, definition string")
    assert [(r.alias, r.full_name) for r in ingest.aliases(rows, (), ()).collect()] == [("丁戊己", "甲乙丙公司")]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("2", "A", 1, 2, 3), ("1", "B", 4, 5, 9)], "qid string, answer string, prompt_tokens long, completion_tokens long, total_tokens long")
    sinks.write_answers(a, str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("part-*.csv")).read_text().split("\n")
    assert lines[0].startswith("qid,") and lines[1].startswith("summary,") and lines[1].endswith("5,7,12") and lines[2].startswith("1,B")
    rows = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int")
    assert [keyed.append_new(rows, str(tmp_path / "t"), "k"), keyed.append_new(rows.unionByName(spark.createDataFrame([("k3", 3)], "k string, v int")), str(tmp_path / "t"), "k")] == [2, 1]
    assert [r.batch for r in sinks.batches(spark.range(5).withColumnRenamed("id", "qid"), 2).orderBy("qid").collect()] == [0, 0, 1, 1, 2]
    sinks.write_index({"n": rows.withColumn("domain", F.lit("d"))}, str(tmp_path / "i"), "f1")
    assert sinks.read_index(spark, str(tmp_path / "i"), "f2") is None and sinks.read_index(spark, str(tmp_path / "i"), "f1")["n"].count() == 2
    assert [*spark.createDataFrame([("甲；乙",)], "a string").select(*sinks.split_answer(F.col("a"))).first()] == ["甲", "乙", "", ""]


def test_question_readers(spark, tmp_path):
    (tmp_path / "a_questions.json").write_text('[{"qid":"2","domain":"d","doc_ids":["x"],"type":"tf"},{"qid":"1","domain":"e","doc_ids":["x"]}]')
    (tmp_path / "b.jsonl").write_text('{"qid":"3","domain":"f"}\n')
    q = ingest.questions(spark, str(tmp_path / "*_questions.json"))
    assert [(r.qid, r.ord, r.answer_format) for r in q.orderBy("ord").collect()] == [("2", 1, "tf"), ("1", 2, None)]
    assert ingest.domain_mapping(q).first().domain == "e"
    assert [r.qid for r in ingest.mixed_questions(spark, [str(tmp_path / "a_questions.json")], [str(tmp_path / "b.jsonl")]).collect()] == ["1", "2", "3"]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "t")], "chunk_id string, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        s = stream.chunk_stream(spark, str(tmp_path / "in"), "chunk_id string, text string")
        stream.upsert_stream(s, str(tmp_path / "out"), "chunk_id", str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_mentions_within_longer_ones(spark):
    rows = spark.createDataFrame([("a", "华星科技；《甲乙2024》；2024年；第3条；国寿福"), ("b", "")], "chunk_id string, text string")
    every = {(r.type, r.name, r.start) for r in entities.mentions(rows).collect()}
    outer = {(r.type, r.name, r.start) for r in entities.mentions(rows, nested=False).collect()}
    assert every - outer == {("product", "甲乙2024", 6)}
    assert {("regulation", "《甲乙2024》", 5), ("period", "期间_2024", 14), ("product", "国寿福", 24)} <= outer
