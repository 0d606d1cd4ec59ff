from pyspark.sql import functions as F

from lodeseam.operators import answering, entities, evidence, graph_ranking, judge, postings, search
from lodeseam.service import Service

CHUNK = "domain string, doc_id string, chunk_id string, chunk_no int, text string, has_table boolean, page int"
QUESTION = "qid string, domain string, question string, options map<string,string>, answer_format string, doc_ids array<string>"


def chunks(spark):
    rows = [("financial_contracts", "a", "a1", 0, "本期债券受托管理人为国信证券，发行规模10亿元，期限3年。", False, 1), ("financial_contracts", "a", "a2", 1, "违约金按日计算", False, 1), ("financial_contracts", "b", "b1", 0, "受托管理人为中泰证券，发行规模20亿元", False, 1)]
    return spark.createDataFrame(rows, CHUNK)


def question(**more):
    return {"qid": "1", "domain": "financial_contracts", "question": "受托管理人与发行规模，哪些正确", "options": {"A": "受托管理人为国信证券", "B": "发行规模10亿元", "C": "总额金额500张"}, "answer_format": "multi", "doc_ids": ["a"]} | more


def ask_df(spark, **more):
    q = question(**more)
    return spark.createDataFrame([tuple(q[n] for n in ("qid", "domain", "question", "options", "answer_format", "doc_ids"))], QUESTION)


def test_rules_answer(spark):
    docs = spark.createDataFrame([("a", "受托管理人为国信证券，发行规模10亿元")], "doc_id string, text string")
    assert answering.by_rules(chunks(spark), ask_df(spark)).first().answer == "AB"
    assert answering.by_rules(chunks(spark), ask_df(spark), docs).first().answer == "AB"


def test_ask_with_a_model_and_tools(spark):
    said = iter([{"content": "", "tool_calls": [{"name": "search_number", "arguments": {"number": "10", "unit": "亿元"}}, {"name": "nothing"}], "tokens": 5}, {"content": "见[证据1][证据99]，10亿元。答案：AB", "tokens": 7}])
    got = answering.ask(chunks(spark), question(), lambda messages: next(said))
    assert (got["answer"], got["answer_source"], got["tokens"]) == ("AB", "model", 12)
    assert got["citations"]["valid"] == [1] and got["citations"]["invalid"] == [99]
    assert [c["hits"] for c in got["tool_calls"]] == [1, 0] and got["unsupported_numbers"] == ["99"]
    assert answering.run_tool("search_phrase", {}, chunks(spark), {})[0]["error"]


def test_service(spark):
    s = Service(chunks(spark))
    assert s.handle("GET", "/health", {})[1]["domains"] == ["financial_contracts"]
    status, rows = s.handle("GET", "/search", {"question": "受托管理人", "domain": "financial_contracts", "doc_ids": "a, b", "top_k": 2})
    assert status == 200 and len(rows) == 2
    assert s.handle("GET", "/search", {"question": "x", "domain": "d", "top_k": 31})[0] == 422 and s.handle("GET", "/x", {})[0] == 404
    assert s.handle("POST", "/ask", question())[1]["answer"] == "AB"


def test_domain_synonyms(spark):
    q = ask_df(spark, question="违约后如何", options={})
    terms = {r.term for r in search.query_terms(q, {}, by_domain=True).collect()}
    assert "违约金" in terms and "违约金" not in {r.term for r in search.query_terms(q, {}).collect()}


def test_evidence_texts(spark):
    rows = [("1", 1, "a", "x1", 1.5, "第一条 " + "x" * 50), ("1", 2, "b", "x2", 1.0, "y" * 50), ("2", 1, "a", "x1", 1.0, "z")]
    e = spark.createDataFrame(rows, "qid string, rank int, doc_id string, chunk_id string, score double, text string")
    got = {r.qid: r for r in evidence.headed(e, cut=10, budget=None).collect()}
    assert "x" * 50 in got["1"].evidence and "y" * 10 + "..." in got["1"].evidence and got["1"].n_used == 2
    assert {r.qid: r.n_used for r in evidence.headed(e, cut=10, budget=90).collect()}["1"] == 1
    assert evidence.numbered(e, start=3).where("qid = '2'").first().evidence == "- [证据3] (a) z"


def test_evidence_by_option_and_scan(spark):
    got = {(r.option, r.chunk_id) for r in evidence.by_option(chunks(spark), ask_df(spark)).collect()}
    assert ("B", "a1") in got and all(c.startswith("a") for _, c in got)
    docs = spark.createDataFrame([("a", "前" * 50 + "受托管理人" + "后" * 50)], "doc_id string, text string")
    assert evidence.scanned(docs, ask_df(spark, question="受托管理人")).first().match_count == 1


def test_mentions(spark):
    c = spark.createDataFrame([("c", "比亚迪股份有限公司2024年净利润为1,234万元，占5%，见《公司法》第三条"), ("n", None)], "chunk_id string, text string")
    got = {(r.type, r.name, r.value) for r in entities.mentions(c).collect()}
    assert {("company", "比亚迪股份有限公司", "比亚迪股份有限公司"), ("company", "比亚迪", "比亚迪股份有限公司"), ("amount", "金额_1,234", "1234"), ("percentage", "比例_5%", "5"), ("regulation", "《公司法》", "《公司法》"), ("clause", "条款_三", "三"), ("period", "期间_2024", "2024"), ("metric", "净利润", "净利润")} <= got
    r = entities.by_type(entities.mentions(c)).first()
    assert r.amount == ["1234"] and "净利润" in r.metric


def test_key_facts_and_targets(spark):
    df = spark.createDataFrame([("第一份文档明确指定的是广东省广晟控股集团有限公司，评级AA+，规模10亿元", ["x", "y"])], "o string, d array<string>")
    r = df.select(entities.key_facts(F.col("o")).alias("f"), entities.target_documents(F.col("o"), F.col("d")).alias("t"), entities.target_documents(F.lit("无"), F.col("d")).alias("all")).first()
    assert {"广东省广晟控股集团有限公司", "AA+", "10亿元"} <= set(r.f) and [x.doc_id for x in r.t] == ["x"] and [x.label for x in r.all] == ["all", "all"]
    docs = spark.createDataFrame([("a", "受托管理人为国信证券")], "doc_id string, text string")
    got = {r.option: r.support for r in answering.option_facts(ask_df(spark), docs).collect()}
    assert got["A"] == "whole" and got["C"] == "none"


def test_lookups(spark):
    c = chunks(spark)
    got = {(r.kind, r.task) for r in answering.lookups(ask_df(spark, options={"A": "规模10亿，国信证券"}), c, answering.indexes(c)).collect()}
    assert ("number", "10") in got or ("entity", "国信证券") in got


def test_graph_rankings(spark):
    c = chunks(spark)
    q = ask_df(spark)
    scope = c.select(F.lit("1").alias("qid"), "chunk_id")
    got = {r.chunk_id: r.score for r in graph_ranking.idf_search(q, scope, postings.phrase(c), postings.inverted(c), postings.numeric(c)).collect()}
    assert got["a1"] >= 50
    assert graph_ranking.symbol_recall(q, postings.symbols(c)).count() > 0
    names = spark.createDataFrame([("1", "国信证券")], "qid string, name string")
    reached = c.select(F.lit("1").alias("qid"), "chunk_id", F.lit(1).alias("depth"), F.lit("financial_contracts").alias("domain"))
    walked = {r.chunk_id: r.score for r in graph_ranking.score_walk(reached, c, names, postings.entity(c)).collect()}
    assert walked["a1"] > walked["a2"] == 0.0
    s = spark.createDataFrame([("1", "a", 2.0)], "qid string, chunk_id string, score double")
    m = spark.createDataFrame([("1", "a", 1), ("1", "b", 2)], "qid string, chunk_id string, m int")
    assert {r.chunk_id: r.score for r in graph_ranking.number_boost(s, m).collect()} == {"a": 12.0, "b": 100.0}
    assert graph_ranking.keyword_fallback(ask_df(spark, question="受托管理人"), c).count() == 2


def test_table_alignment(spark):
    df = spark.createDataFrame([("2024年占比66.38%", "|a|2022|b|66.38%|")], "o string, e string")
    assert df.select(judge.misplaced_years(F.col("o"), F.col("e"))).first()[0] == -2.0


def test_two_paths_and_source_check(spark):
    items = spark.createDataFrame([("1", "a", 2, "1,234;x"), ("2", "b", 1, "none")], "qid string, source_doc string, source_page int, source_anchor string")
    ranked = spark.createDataFrame([("1", "z", "1,234", 1), ("1", "a", "val 1234", 2), ("2", "a", "t", 1)], "qid string, doc_id string, text string, rank int")
    from lodeseam.operators import metrics

    got = {r.qid: (r.doc_hit, r.anchor_hit, r.recall_rank) for r in metrics.two_paths(items, ranked).collect()}
    assert got == {"1": (True, True, 2), "2": (False, False, 0)}
    pages = spark.createDataFrame([("a", 1, "1,234"), ("a", 2, "other")], "doc_id string, page_num int, text string")
    assert {r.qid: (r.anchor_ok, r.page_ok) for r in metrics.source_check(items, pages).collect()} == {"1": (True, False), "2": (False, False)}


def test_retrieval_answer_and_small_ones(spark, tmp_path):
    from lodeseam.operators import evalset, graph
    from lodeseam.sources import ingest

    rows = [("1", "mcq", "A", "甲公司", "乙公司1,234", ""), ("1", "mcq", "B", "乙公司1,234", "乙公司1,234", ""), ("2", "tf", "A", "无", "有", None), ("3", "multi", "A", "x", "有", "x"), ("3", "multi", "B", "y", "有", ""), ("3", "multi", "C", "z", "有", "")]
    df = spark.createDataFrame(rows, "qid string, answer_format string, option string, option_text string, evidence string, source_anchor string")
    assert {r.qid: r.answer for r in judge.retrieval_answer(df).collect()} == {"1": "B", "2": "B", "3": "AB"}
    one = spark.createDataFrame([('text {"answer": "AB", "evidence": ["x"]} end', ["short", "a rule that is long enough"], ["n", "name"])], "t string, r array<string>, n array<string>")
    r = one.select(judge.audit_fields(F.col("t")).alias("a"), evidence.knowledge(F.col("r"), F.col("n")).alias("k"), evalset.sane(F.lit("营业收入"), F.lit("5%")).alias("s"), evalset.sane(F.lit("收益率"), F.lit("5%")).alias("s2"), evalset.clean_name(F.lit("净利润")).alias("c")).first()
    assert r.a.answer == "AB" and r.k.rules == ["a rule that is long enough"] and r.k.names == ["name"] and (r.s, r.s2, r.c) == (False, True, True)
    (tmp_path / "f.json").write_text('{"qid": "1", "answer": "A"}\n{"qid": "1", "answer": "B"}\n')
    assert ingest.answers(spark, str(tmp_path / "f.json")).first().answer == "B"
    a = ingest.fingerprint(spark, str(tmp_path / "f.json"), k=1)
    assert a == ingest.fingerprint(spark, str(tmp_path / "f.json"), k=1) != ingest.fingerprint(spark, str(tmp_path / "f.json"), k=2)
    c = chunks(spark)
    graph.save(graph.nodes(c, postings.entity(c)), graph.sequence_edges(c), str(tmp_path / "g"))
    assert graph.load(spark, str(tmp_path / "g"))[1].count() == 2


def test_baselines_and_patience(spark):
    c, q = chunks(spark), ask_df(spark)
    assert answering.baseline("bare", c, q).count() == 0
    v = spark.createDataFrame([("1", "b1", 1)], "qid string, chunk_id string, vec_rank int")
    assert answering.baseline("vector", c, q, vectors=v).first().chunk_id == "b1"
    assert answering.baseline("symbolic", c, q).count() == 2 and answering.baseline("full", c, q, 2).count() == 2
    calls = []

    def flaky(messages):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return {"content": "ok"}

    assert answering.patient(flaky, wait=0)([])["content"] == "ok"


def test_checks_are_dealt_to_all_tasks(spark):
    """options are dealt by more than the questions, so that the checks are not left to the few tasks that a join's bytes give."""
    import re

    q = spark.createDataFrame([question(answer_format="multi", doc_ids=["a"])], QUESTION)
    plan = re.sub(r"#[0-9]+L?", "", answering.by_rules(chunks(spark), q)._jdf.queryExecution().executedPlan().toString())
    assert "hashpartitioning(qid, option, " in plan


def test_texts_are_made_once_for_all_triggers(spark):
    """the text of question and options is not put together again for each trigger that it may contain."""
    q = spark.createDataFrame([question()], QUESTION)
    plan = search.query_terms(q)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_values(options") == 1
