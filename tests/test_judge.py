import random

import pytest
from pyspark.sql import functions as F

from lodeseam.operators import graph, judge, metrics


def check(spark, f, option, evidence):
    return spark.createDataFrame([(option, evidence)], "o string, e string").select(f(F.col("o"), F.col("e")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "option", "evidence", "want"),
    [
        (judge.year_value, "2024年占比66.38%", "|指标|2024|2022|\n|---|---|---|\n|占比|50.00%|66.38%|", judge.HARD),
        (judge.year_value, "2022年占比66.38%", "|指标|2024|2022|\n|---|---|---|\n|占比|50.00%|66.38%|", 0.0),
        (judge.numeric_precision, "金额827,664.20万元", "金额82,766.42万元", judge.HARD),
        (judge.numeric_precision, "金额82,766.42万元", "金额82766.42万元", 0.0),
        (judge.threshold_exceeded, "超过30%", "实际为28.08%", judge.HARD),
        (judge.threshold_exceeded, "超过30%", "不超过总额的30%，实际45%", judge.HARD),
        (judge.threshold_exceeded, "超过30%", "实际为5%", 0.0),
        (judge.unit_consistency, "募集资金总额为2,429,326张", "任意", judge.HARD),
        (judge.unit_consistency, "金额28417.20万元", "金额28417.20元", -1.0),
        (judge.unit_consistency, "金额28417.20万元", "金额28417.20万元", 0.0),
        (judge.threshold_exceeded, "超过30%", "不超过30", 0.0),
        (judge.threshold_exceeded, "超过30%", "实际为5.25%", judge.HARD),
        (judge.year_value, "2024年占比66.38%", "占比在2022年为66.38%", judge.HARD),
        (judge.year_value, "2024年占比66.38%", "占比在2022年为66.38%，" + "，" * 80 + "2024年66.38%", 0.0),
        (judge.year_value, "2024年占比66.38%", "|指标 2024 2022|x|\n|| |66.38%|", 0.0),
        (judge.subject_alignment, "标的公司净资产5000万元", "控股股东净资产5000万元", -3.5),
        (judge.subject_alignment, "标的公司净资产5000万元", "标的公司净资产5000万元", 0.0),
        (judge.subject_alignment, "标的公司净资产5000万元", "净资产5000万元", 0.0),
        (judge.subject_alignment, "标的公司净资产5000万元", "", 0.0),
        (judge.subject_alignment, "标的公司净资产5000万元", "标的公司控股股东净资产5000万元", -5.0),
        (judge.subject_alignment, "标的公司宏济堂为43.24%", "标的公司控股股东力诺投资为43.24%", judge.HARD),
        (judge.subject_alignment, "标的公司宏济堂为43.24%", "标的公司控股股东力诺投资为43.24%" + "，" * 200 + "宏济堂为43.24%", -5.0),
        (judge.unit_consistency, "金额28,417.20万元", "金额28417.20元", -2.0),
        (judge.unit_consistency, "占比12.5%，2024年", "12.5元，2024元，", -2.0),
        (judge.unit_consistency, "发行3股", "任意", 0.0),
        (judge.concept_value, "逾期利息的基数为本金和利息", "逾期利息计算方式为本金×票面利率", judge.HARD),
        (judge.concept_value, "逾期利息的基数为本金和利息", "逾期利息的基数为本金和利息", 0.0),
        (judge.concept_value, "逾期利息的基数为本金", "违约金的基数为本金和利息", 0.0),
        (judge.concept_value, "违约金的计算基数仅本金", "", judge.HARD),
        (judge.procedure_alignment, "变更名称由分支机构审查、决定", "变更名称" + "，" * 250 + "审查、决定", judge.HARD),
        (judge.procedure_alignment, "变更名称由分支机构审查、决定", "变更名称的，由其审查决定", 0.0),
        (judge.procedure_alignment, "变更名称由分支机构审查、决定", "变更住所", 0.0),
        (judge.procedure_alignment, "变更名称", "变更名称", 0.0),
        (judge.misplaced_years, "2024年20亿元，2024年20亿元", "|a|2023|20|x|", -8.0),
        (judge.misplaced_years, "2024年20亿元", "|a|2024|20|x|", 0.0),
        (judge.misplaced_fields, "本次发行规模为180亿元", "本次发行规模为90亿元" + "，" * 90 + "注册金额180亿元", -3.0),
        (judge.misplaced_fields, "本次发行规模为180亿元", "本次发行规模为90亿元" + "，" * 190 + "另有180亿元", -1.0),
        (judge.misplaced_fields, "本次发行规模为180亿元", "本次发行规模为180亿元", 0.0),
        (judge.misplaced_fields, "本次发行规模为180亿元", "本次发行规模为90亿元", 0.0),
        (judge.misplaced_fields, "本次发行规模为180亿元", "", 0.0),
        (judge.misplaced_trends, "全部转股后上升至43.81%", "本次发行后转股前为43.81%", -3.0),
        (judge.misplaced_trends, "全部转股后降至26.99%", "本次发行后转股前为26.99%", 0.0),
        (judge.misplaced_trends, "全部转股后上升至43.81%", "为43.81%", 0.0),
        (judge.table_alignment, "超过30%", "实际为28.08%", judge.HARD),
        (judge.table_alignment, "2024年20亿元，2024年20亿元", "|a|2023|20|x|", -6.0),
        (judge.table_alignment, "2024年20亿元", "2024年20亿元", 0.0),
        (judge.option_score, "2024年占比66.38%", "|指标|2024|2022|\n|---|---|---|\n|占比|50.00%|66.38%|", 0.0),
        (judge.option_score, "超过30%", "实际为28.08%", 0.0),
        (judge.option_score, "第五条规定", "第五条规定", 6.0),
        (judge.field_value, "全部转股后上升至43.81%", "|指标|全部转股后|本次发行后转股前|\n|---|---|---|\n|负债率|26.99%|43.81%|", judge.HARD),
        (judge.field_value, "本次发行后转股前为43.81%", "|指标|全部转股后|本次发行后转股前|\n|---|---|---|\n|负债率|26.99%|43.81%|", 0.0),
        (judge.field_value, "全部转股后上升至43.81%", "全部转股后，本次发行后转股前43.81%", 0.0),
        (judge.field_value, "负债率为43.81%", "|指标|全部转股后|本次发行后转股前|\n|负债率|26.99%|43.81%|", 0.0),
    ],
)
def test_checks(spark, f, option, evidence, want):
    assert check(spark, f, option, evidence) == want


@pytest.mark.parametrize(
    ("option", "evidence", "want"),
    [
        ("无需报告", "应当在10日内报告", True),
        ("无需报告，但应当于变更后补报", "应当在10日内报告", False),
        ("赔付100万元", "对100万元不予赔付", True),
        ("赔付100万元", "赔付100万元", False),
        ("赔付100万元", "赔付100万元" + "，" * 30 + "不予", False),
        ("赔付100万元", "赔付100万元" + "，" * 30 + "100万元不予赔付", True),  # one place is enough
        ("不得转让该股份，限售期届满", "限售期届满，转让该股份", False),
        ("禁止提前赎回，限售期届满，转让该股份", "限售期届满以后转让该股份", True),  # the denial is the option's own
        ("注册资本无需附加", "仅从事第二类业务的，注册资本无需附加", True),
        ("仅从事第二类业务的，注册资本无需附加", "仅从事第二类业务的，注册资本无需附加", False),
        ("注册资本无需附加", "注册资本无需附加", False),
        ("非银行支付机构于10日内变更", "非银行支付机构不得于10日内变更", False),  # 不得 doesn't count there
        ("非银行支付机构于10日内变更", "于10日无需变更", True),
        ("标的公司承担赔偿", "标的公司不承担赔偿", True),
        ("全体董事承担", "全体董事承担的说法错误", True),
        ("全体董事承担", "其他", False),
        ("", "", False),
    ],
)
def test_negation(spark, option, evidence, want):
    assert check(spark, judge.negated, option, evidence) is want


def test_score_orders_options(spark):
    good, bad = "受托管理人为国信证券，规模10亿元", "受托管理人为中泰证券，规模99亿元"
    e = "本期债券受托管理人为国信证券，发行规模10亿元"
    assert check(spark, judge.option_score, good, e) > check(spark, judge.option_score, bad, e) >= 0
    assert check(spark, judge.option_score, "的", e) == 0


def options(spark, rows):
    return spark.createDataFrame(rows, "qid string, answer_format string, question string, option string, option_text string, evidence string")


def test_reason(spark):
    e = "受托管理人为国信证券，发行规模10亿元，期限3年"
    rows = [("m", "multi", "q", k, t, e) for k, t in (("A", "受托管理人为国信证券"), ("B", "发行规模10亿元"), ("C", "总额金额500张"))]
    rows += [("s", "mcq", "q", k, t, e) for k, t in (("A", "无关内容文字"), ("B", "受托管理人为国信证券"))]
    rows += [("t", "tf", "受托管理人，发行规模，期限三年", "A", "", e), ("n", "multi", "q", "A", "甲乙丙", None), ("n", "multi", "q", "B", "丁戊己", None)]
    got = {r.qid: r.answer for r in judge.reason(options(spark, rows)).collect()}
    assert got == {"m": "AB", "s": "B", "t": "A", "n": "AB"}


def test_a_hard_failure_leaves_an_option_without_points(spark):
    e = "|指标|2024|2022|\n|---|---|---|\n|占比|50.00%|66.38%|"
    rows = [("m", "multi", "q", "A", "2024年占比66.38%", e), ("m", "multi", "q", "B", "丁戊己", e), ("o", "mcq", "q", "A", "2024年占比66.38%", e), ("o", "mcq", "q", "B", "占比", e)]
    assert {r.qid: r.answer for r in judge.reason(options(spark, rows)).collect()} == {"m": "AB", "o": "B"}


def packed_by_hand(rows, most, any_tables, any_texts):
    out = []
    for tables in (True, False):
        for doc, table, rank in sorted(rows, key=lambda r: (r[2], r[0])):
            if table == tables and len(out) < most and (len(out) < (any_tables if tables else any_texts) or doc not in {d for d, _ in out}):
                out.append((doc, rank))
    return out


def test_packing_of_evidence(spark):
    rng = random.Random(3)
    cases = {"one": [("a", True, k) for k in range(5)] + [("a", False, k) for k in range(5, 11)], "none": []}
    cases |= {f"r{k}": [(rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.choice([2, 8, 26])]), rng.random() < rng.choice([0, 0.3, 0.9]), n) for n in range(rng.choice([1, 9, 60]))] for k in range(40)}
    df = spark.createDataFrame([(q, *r) for q, rows in cases.items() for r in rows], "qid string, doc_id string, has_table boolean, rank int")
    for most, any_tables, any_texts in ((8, 3, 5), (4, 1, 2), (8, 0, 0)):
        got = {}
        for r in graph.pack(df, most, any_tables, any_texts).orderBy("qid", "place").collect():
            got.setdefault(r.qid, []).append((r.doc_id, r["rank"]))
        assert got == {q: w for q, rows in cases.items() if (w := packed_by_hand(rows, most, any_tables, any_texts))}
    assert [r[0] for r in packed_by_hand(cases["one"], 8, 3, 5)] == ["a"] * 5


def test_verify_multi(spark):
    o = spark.createDataFrame([("1", k, t, ["d"]) for k, t in (("A", "收入1,234.5万元"), ("B", "等待期12个月"), ("C", "利率9.99%"))], "qid string, option string, option_text string, doc_ids array<string>")
    chunks = spark.createDataFrame([("d", "收入1234.5万元"), ("d", "等待期为12个月")], "doc_id string, text string")
    a = spark.createDataFrame([("1", "C", "model"), ("2", "A", "model")], "qid string, answer string, answer_source string")
    got = {r.qid: (r.answer, r.answer_source) for r in judge.verify_multi(o, chunks, a).collect()}
    assert got["1"][1] == "anchor_verified" and got["1"][0] == "AB" and got["2"] == ("A", "model")


def test_citations_and_numbers(spark):
    df = spark.createDataFrame([("[证据1][证据12] 12,132 7 55", ["12132"])], "t string, e array<string>")
    r = df.select(judge.citation_check(F.col("t"), F.lit(5)).alias("c"), judge.unsupported_numbers(F.col("t"), F.col("e")).alias("u")).first()
    assert (r.c.valid, r.c.invalid, r.c.coverage) == ([1], [12], 0.2) and "55" in r.u and "12,132" not in r.u


def test_settle(spark):
    rows = [("答案：B", "mcq", {"A": "1.5", "B": "2.5"}, False, True, ["x"]), ("结果是1.50和2.50", "mcq", {"A": "1.50", "B": "2.50"}, False, False, ["x"]), ("文档中未提及", "mcq", {"A": "1", "B": "2"}, True, False, ["x"]), ("答案：AC", "multi", {"A": "1", "C": "2"}, False, False, [])]
    df = spark.createDataFrame(rows, "final_text string, answer_format string, options map<string,string>, is_trap boolean, has_valid_citation boolean, evidence array<string>")
    got = [(r.answer, r.answer_source) for r in judge.settle(df).collect()]
    assert got == [("B", "model"), ("B", "model_value_matched"), ("REFUSED", "trap_refused"), ("AC", "model")]


def test_credit_and_letters(spark):
    df = spark.createDataFrame([("ABD", "AB", False, "multi"), ("ABD", "ABC", False, "multi"), ("ABD", "C", False, "multi"), ("REFUSED", "", True, "mcq"), ("A", "REFUSED", False, "mcq"), ("A", "a", False, "mcq")], "g string, a string, r boolean, f string")
    got = [round(r.x, 4) for r in df.select(metrics.credit(F.col("g"), F.col("a"), F.col("r"), F.col("f")).alias("x")).collect()]
    assert got == [0.6667, 0.3333, 0.0, 1.0, 0.0, 1.0]
    assert check(spark, lambda o, e: metrics.answer_letters(o), "REFUSED", "") == "D"


def test_fallback(spark):
    rows = [("1", "multi", "A", "甲公司5亿元", 1, ["x"]), ("1", "multi", "B", "乙公司2024", 0, ["乙公司2024年"]), ("1", "multi", "C", "丙", 0, ["x"]), ("2", "mcq", "A", "x", 0, None), ("2", "mcq", "B", "y", 2, None), ("3", "tf", "A", "", 0, ["不得承担，禁止"])]
    df = spark.createDataFrame(rows, "qid string, answer_format string, option string, option_text string, n_evidence int, evidence array<string>")
    assert {r.qid: r.answer for r in judge.fallback(df).collect()} == {"1": "AB", "2": "B", "3": "B"}


def test_metrics_count_items_without_gold_as_misses(spark):
    ranked = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "c", 1)], "qid string, chunk_id string, rank int")
    gold = spark.createDataFrame([("1", "b")], "qid string, chunk_id string")
    items = spark.createDataFrame([("1", "x", "d"), ("2", "x", "d"), ("3", "y", "d")], "qid string, layer string, domain string")
    got = {(r.level, r.value): (r.n, r.hit, round(r.recall, 4), round(r.mrr, 4)) for r in metrics.retrieval(metrics.first_hits(ranked, gold, items)).collect()}
    assert got[("all", "")] == (3, 1, 0.3333, 0.1667) and got[("layer", "x")] == (2, 1, 0.5, 0.25) and got[("domain", "d")][0] == 3
    assert "| level |" in metrics.report(metrics.retrieval(metrics.first_hits(ranked, gold, items)), "t")
