import re

from pyspark.sql import functions as F

from lodeseam.operators import evalset
from lodeseam.plans import cases, queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stratum_is_cut_before_it_is_shuffled(spark):
    items = spark.range(2000).select(F.concat(F.lit("q"), "id").alias("question"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("layer"))
    some = evalset.stratified(items, {"a": 7, "b": 3})
    assert plan(some).count("WindowGroupLimit") == 2  # in each task, and after the shuffle
    assert {r["layer"]: r["count"] for r in some.groupBy("layer").count().collect()} == {"a": 7, "b": 3}


def test_texts_made_of_small_tables_are_many_tasks_work(spark):
    for df in (queries._metric_chunks(spark, "/root/testdata/sf0.001"), cases._cases(spark, "/root/testdata/sf0.001")):
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_documents_of_one_metric_are_taken_by_twos(spark):
    rows = [("d", f"doc{i:02}", f"c{i}", 0, "营业收入", True, str(100 + i), str(100 + i), "万元", "s", "") for i in range(21)]
    pairs = spark.createDataFrame(rows, "domain string, doc_id string, chunk_id string, pos int, metric string, is_vocab boolean, num string, num_core string, unit string, sentence string, entity string")
    order = [r.doc_id for r in pairs.orderBy(evalset.shuffled(42, "doc_id"), "doc_id").collect()]
    got = {tuple(r.gold_doc_ids): r.gold_answer for r in evalset.multi_hop(pairs).collect()}
    assert got == {(a, b): "A" if a > b else "B" for a, b in zip(order[::2], order[1::2])}
    # no window over all documents of a metric is left
    assert not re.search(r"Window \[row_number\(\)[^\n]*\[_h", plan(evalset.multi_hop(pairs)))


def test_items_with_their_chunks_text_are_judged_where_they_are(spark):
    rows = [("d", f"doc{i}", f"c{i}", i, f"营业收入为{1000 + i}万元。净利润达到{500 + i}万元") for i in range(12)]
    chunks = spark.createDataFrame(rows, "domain string, doc_id string, chunk_id string, chunk_no int, text string")
    bare, told = (evalset.metric_pairs(chunks, with_text=t).repartition("chunk_id") for t in (False, True))
    for kind in (evalset.single_hop, evalset.true_false, evalset.logical_compare, lambda p: evalset.calc(p, chunks)):
        judged = evalset.quality(kind(told), chunks)
        assert sorted(judged.collect(), key=str) == sorted(evalset.quality(kind(bare), chunks).collect(), key=str) and judged.count() >= 10
    # neither the texts nor the items are shuffled, and windows over a chunk share its deal
    assert "Join" not in plan(evalset.quality(evalset.true_false(told), chunks))
    assert plan(evalset.quality(evalset.calc(told, chunks), chunks)).count("Exchange") == 1


def test_values_in_the_sentence_are_passed_over_in_the_whole_pool(spark):
    said = "，".join(str(n) for n in range(10, 60))
    rows = [("d", "doc", "c", k, "营业收入", True, str(n), str(n), "元", said if n == 10 else "s", "") for k, n in enumerate(range(10, 60))]
    pairs = spark.createDataFrame(rows, "domain string, doc_id string, chunk_id string, pos int, metric string, is_vocab boolean, num string, num_core string, unit string, sentence string, entity string")
    got = {r.source_anchor: set(r.options) for r in evalset.single_hop(pairs).collect()}
    assert got["10"] == {"10", "20", "11", "1"} and all(len(o) == 4 for o in got.values())


def test_pairs_are_not_dealt_by_their_few_units(spark):
    pairs = evalset.metric_pairs(queries._metric_chunks(spark, "/root/testdata/sf0.001"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        got = plan(evalset.single_hop(pairs))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in got and "SortMergeJoin" not in got
