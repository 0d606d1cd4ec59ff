"""Queries that run operators over made-up cases, one set for each supplier, with numbers of that supplier in the texts. A case says
what must come out; the SQL is nothing but these statements. {n} is 3000 + s_suppkey, {m} is s_suppkey % 90 + 10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, text
from ..operators import entities, evalset, judge, metrics, tools
from ..operators.steps import spread
from .registry import query, table

TABLE_YEARS = "|指标|2024|2022|\n|---|---|---|\n|占比|50.00%|{m}.38%|"
TABLE_STAGES = "|指标|全部转股后|本次发行后转股前|\n|---|---|---|\n|负债率|26.99%|{m}.81%|"

#: (name, function of option and evidence, option, evidence, result)
CHECKS = (
    ("year_in_other_column", judge.year_value, "2024年占比{m}.38%", TABLE_YEARS, -100.0),
    ("year_in_own_column", judge.year_value, "2022年占比{m}.38%", TABLE_YEARS, 0.0),
    ("year_beside_other_year", judge.year_value, "2024年占比{m}.38%", "2022年占比为{m}.38%", -100.0),
    ("year_without_share", judge.year_value, "2024年占比{m}%", TABLE_YEARS, 0.0),
    ("stage_in_other_column", judge.field_value, "全部转股后上升至{m}.81%", TABLE_STAGES, -100.0),
    ("stage_in_own_column", judge.field_value, "本次发行后转股前为{m}.81%", TABLE_STAGES, 0.0),
    ("amount_with_other_digits", judge.numeric_precision, "金额{m},664.20万元", "金额{m},66.42万元", -100.0),
    ("amount_without_commas", judge.numeric_precision, "金额{m},664.20万元", "金额{m}664.20万元", 0.0),
    ("over_a_limit", judge.threshold_exceeded, "超过{m}%", "不超过总额的{m}%", -100.0),
    ("over_what_is_less", judge.threshold_exceeded, "超过{m}%", "实际为{m}.01%，不足100%", 0.0),
    ("units_differ", judge.unit_consistency, "金额{n}.20万元", "金额{n}.20元", -1.0),
    ("amount_in_pieces", judge.unit_consistency, "募集资金总额为{n}张", "任意", -100.0),
    ("units_agree", judge.unit_consistency, "金额{n}.20万元", "金额{n}.20万元", 0.0),
    ("subject_confused", judge.subject_alignment, "标的公司净资产{n}万元", "控股股东净资产{n}万元", -3.5),
    ("subject_of_subject", judge.subject_alignment, "标的公司净资产{n}万元", "标的公司控股股东净资产{n}万元", -5.0),
    ("subject_of_company", judge.subject_alignment, "标的公司宏济堂为{n}万元", "标的公司控股股东力诺投资为{n}万元", -100.0),
    ("subject_agrees", judge.subject_alignment, "标的公司净资产{n}万元", "标的公司净资产{n}万元", 0.0),
    ("base_of_other_concept", judge.concept_value, "逾期利息的基数为本金和利息", "逾期利息计算方式为本金×{m}%", -100.0),
    ("base_agrees", judge.concept_value, "逾期利息的基数为本金和利息", "逾期利息的基数为本金和利息，共{m}元", 0.0),
    ("procedure_elsewhere", judge.procedure_alignment, "变更名称由{m}家机构审查、决定", "变更名称的，{n}日内报告", -100.0),
    ("procedure_near", judge.procedure_alignment, "变更名称由{m}家机构审查、决定", "变更名称由{m}家机构审查决定", 0.0),
    ("years_in_lines", judge.misplaced_years, "2024年{m}亿元", "|a|2023|{m}|x|", -2.0),
    ("field_of_other_name", judge.misplaced_fields, "本次发行规模为{n}亿元", "本次发行规模为九亿元" + "，" * 90 + "注册金额{n}亿元", -3.0),
    ("field_elsewhere", judge.misplaced_fields, "本次发行规模为{n}亿元", "本次发行规模为九亿元" + "，" * 190 + "另有{n}亿元", -1.0),
    ("stage_reversed", judge.misplaced_trends, "全部转股后上升至{m}.81%", "本次发行后转股前为{m}.81%", -3.0),
    ("all_of_a_table", judge.table_alignment, "2024年{m}亿元，2024年{m}亿元，2024年{m}亿元，2024年{m}亿元", "|a|2023|{m}|x|", -6.0),
    ("hard_in_a_table", judge.table_alignment, "2024年占比{m}.38%", TABLE_YEARS, -100.0),
    ("score_of_a_failure", judge.option_score, "2024年占比{m}.38%", TABLE_YEARS, 0.0),
    ("score_of_a_number", judge.option_score, "共{n}年", "共{n}年", 6.0),  # the year and its digits
    ("score_of_words", judge.option_score, "第五条规定", "第五条规定{m}", 6.0),  # the clause and the word
    ("score_of_nothing", judge.option_score, "的", "{m}", 0.0),
    ("denied_nearby", lambda o, e: judge.negated(o, e).cast("double"), "赔付{n}万元", "对{n}万元不予赔付", 1.0),
    ("denied_far_away", lambda o, e: judge.negated(o, e).cast("double"), "赔付{n}万元", "赔付{n}万元" + "，" * 30 + "不予", 0.0),
    ("due_action", lambda o, e: judge.negated(o, e).cast("double"), "无需报告", "应当在{m}日内报告", 1.0),
    ("limited_denial", lambda o, e: judge.negated(o, e).cast("double"), "注册资本无需附加", "仅从事第{m}类业务的，注册资本无需附加", 1.0),
    ("retrieval_points", lambda o, e: judge.retrieval_points(o, e, F.lit("收入")).cast("double"), "收入{n}万元", "收入{n}万元", 37.0),  # 10 whole, 5 number, 20 anchor, 2 runs
    ("borne_by_number", lambda o, e: judge.supported(o, e).cast("double"), "收入{n}.5万元", "收入{n}.5", 1.0),
    ("not_borne", lambda o, e: judge.supported(o, e).cast("double"), "收入{n}.5万元", "收入{n}.55", 0.0),
    ("borne_by_short_number", lambda o, e: judge.supported(o, e).cast("double"), "等待期{m}个月", "等待期为{m} 个月", 1.0),
    ("anchor_of_two", lambda o, e: evalset.anchor_in_text(o, e).cast("double"), "{n}.5;甲方;乙方", "{n}.5与乙方", 1.0),
    ("anchor_missing", lambda o, e: evalset.anchor_in_text(o, e).cast("double"), "{n}.5;甲方;乙方", "乙方", 0.0),
    ("anchor_without_commas", lambda o, e: evalset.anchor_in_text(o, e).cast("double"), "1,{n}.5", "1{n}.5", 1.0),
    ("context_of_words", lambda o, e: tools.context_holds(e, F.split(o, ";")).cast("double"), "收入;{n}", "收入为{n}", 1.0),
    ("context_missing", lambda o, e: tools.context_holds(e, F.split(o, ";")).cast("double"), "利润;{n}", "收入为{n}", 0.0),
    ("hits_apart", lambda o, e: tools.option_hits(e, o)["independent"].cast("double"), "收入", "营业收入{n}，收入 {m}", 2.0),
    ("words_covered", lambda o, e: tools.option_hits(e, o)["ratio"], "收入 利润", "收入{n}", 0.5),
)

#: (name, column of a text, the text, result)
LISTS = (
    ("graph_numbers", extract.graph_numbers, "占{m}.5%，{n}亿元，1,2{m}，共{n}家，2024年", "{m}.5%;{n}亿元;{n}亿;12{m};{m}.5;{n};2{m}"),
    ("anchors", extract.option_anchors, "第{m}条 收入{n}万元，《办法》2023年", "{n}万元;2023年;{n};2023;第{m}条;《办法》"),
    ("option_keywords", extract.option_keywords, "第{m}条 收入{n}万元", "第{m}条;{n}万元;收入;万元"),
    ("cjk_keywords", extract.cjk_keywords, "利润，营业收入{n}，年", "营业收入;利润"),
    ("numbers_with_unit", extract.numbers_with_unit, "1,2{m}万元与{m}%和{m}家", "1,2{m}万元;{m}%;2{m}万元;{m}家"),
    ("split_number", lambda t: F.array(extract.split_number(t)["core"], extract.split_number(t)["unit"]), "{n}.5 万元", "{n}.5;万元"),
    ("citations", lambda t: extract.citations(t).cast("array<string>"), "见[证据{m}][证据 7][证据7]", "7;{m}"),
    ("cited_numbers", extract.cited_numbers, "共1,234与{n}.5", "1,234;{n}.5"),
    ("periods", extract.symbol_periods, "2024年第一季度与2023-06，半年报告{m}", "2024年;第一季度;2023;半年报告"),
    ("amount_symbols", extract.symbol_numbers, "{n} 万元与{m}.5亿元", "{n} 万元;{m}.5亿元"),
    ("clause_symbols", extract.symbol_clauses, "第{m}条、条款 {n}、第（二）款", "第{m}条;条款 {n};第（二）款"),
    ("share_symbols", extract.symbol_percentages, "{m}.5%与{m} %", "{m}.5%;{m} %"),
    ("phrases", lambda t: extract.phrases(t, 2, 6), "营业收入增长很快{n}的", "营业收入增长;很快"),
    ("scan_keywords", lambda t: extract.scan_keywords(t, F.lit("乙{n}方")), "第{m}条 《办法》 收入", "第{m}条;《办法》;办法;收入"),
    ("key_facts", entities.key_facts, "评级AAA，规模{n}亿元", "{n}亿元;AAA"),
    ("plain_number", lambda t: F.array(text.plain_number(t)), " 1,{n}，5 ", "1{n}5"),
    # asked for is all but the last four digits, however many the supplier's number has
    ("number_excerpt", lambda t: F.array(text.excerpt_number(t, F.regexp_extract(t, "(12,345[0-9]*)[0-9]{4}己", 1), 8)), "甲乙丙丁戊12,345{n}己庚", "...乙丙丁戊12,345{n}..."),
    ("document_of_chunk", lambda t: F.array(text.document_of(t)), "text{m}_c1_c{n}", "text{m}_c1"),
    ("answer_of_object", lambda t: F.array(text.answer_text(t)), '{{"answer": "A{m}"}}', "A{m}"),
    ("html", lambda t: F.array(text.html_to_text(t)), "<table><tr><td>a</td><td>{n}</td></tr></table>", "| a | {n}"),
    ("marked_answer", lambda t: F.array(judge.extract_answer(t, F.lit("multi"))), "理由{n}。答案：C、A", "AC"),
    ("cascade_answer", lambda t: F.array(judge.answer_by_cascade(t, F.lit("multi"))), "共{n}项，正确的选项应为 A 和 D", "AD"),
    ("reasoned_answer", lambda t: F.array(judge.answer_of_reasoning(t, F.lit("mcq"))), "共{n}项\n所以 BA", "B"),
    ("any_letters", lambda t: F.array(metrics.answer_letters(t)), "{n}: d, b", "BD"),
    ("refusal", lambda t: F.array(metrics.answer_letters(t)), "{n}：文档中未提及", "REFUSED"),
    ("refused", lambda t: F.array(metrics.is_refused(t).cast("string")), " 拒答{n}", "true"),
    ("refusal_signal", lambda t: F.array(judge.refusal_signal(t).cast("string")), "{n}：文档未提及", "true"),
    ("trap", lambda t: F.array(judge.trap_hint(t, ("请拒答",)).cast("string")), "{n}若未提及请拒答", "true"),
    ("audit_fields", lambda t: F.array(judge.audit_fields(t)["answer"], judge.audit_fields(t)["reasoning"]), '好 {{"answer": "B", "reasoning": "{n}"}} 完', "B;{n}"),
    ("contexts", lambda t: tools.contexts(t, F.lit("甲"), 6, 2), "零一二三甲四五六七甲八", "二三甲四五六;六七甲八"),
    ("places", lambda t: tools.occurrences(t, F.lit("甲")).cast("array<string>"), "甲{m}丙丁甲乙甲", "0;5;7"),
    ("targets", lambda t: F.transform(entities.target_documents(t, F.split(F.lit("x,y"), ",")), lambda d: F.concat_ws(":", d["doc_id"], d["label"])), "第二份文档为{n}", "y:doc2"),
    ("unsupported", lambda t: judge.unsupported_numbers(t, F.array(F.lit("共77家"))), "共77家、{n}家", "{n}"),
    ("citation_check", lambda t: F.transform(F.array(judge.citation_check(t, F.lit(5))["valid"], judge.citation_check(t, F.lit(5))["invalid"]), lambda x: F.concat_ws(",", x.cast("array<string>"))), "[证据1][证据{m}]", "1;{m}"),
)


def _filled(template: str) -> Column:
    """A template with the supplier's numbers."""
    n, m = (F.col("s_suppkey") + 3000).cast("string"), (F.col("s_suppkey") % 90 + 10).cast("string")
    return F.replace(F.replace(F.lit(template.replace("{{", "\x01").replace("}}", "\x02").replace("{n}", "\x03").replace("{m}", "\x04").replace("\x01", "{").replace("\x02", "}")), F.lit("\x03"), n), F.lit("\x04"), m)


def _said(template: str) -> str:
    """The same in SQL."""
    parts = template.replace("{{", "\x01").replace("}}", "\x02").replace("'", "''").replace("{n}", "' || (s_suppkey + 3000) || '").replace("{m}", "' || (s_suppkey % 90 + 10) || '")
    return "'" + parts.replace("\x01", "{").replace("\x02", "}").replace("\n", "' || chr(10) || '") + "'"


def _cases(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey")), "s_suppkey")


@query(" UNION ALL ".join(f"SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, '{name}' AS name, CAST({want} AS DOUBLE) AS result FROM supplier" for name, _, _, _, want in CHECKS))
def option_checks(spark, sf_dir):
    """Checks, scores and supports of options against evidence."""
    each = [F.struct(F.lit(name).alias("name"), f(_filled(option), _filled(evidence)).cast("double").alias("result")) for name, f, option, evidence, _ in CHECKS]
    return _cases(spark, sf_dir).select("s_suppkey", F.explode(F.array(*each)).alias("x")).select("s_suppkey", "x.name", "x.result")


@query(" UNION ALL ".join(f"SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, '{name}' AS name, {_said(want)} AS result FROM supplier" for name, _, _, want in LISTS))
def text_functions(spark, sf_dir):
    """What is taken out of a text, in order, between semicolons."""
    each = [F.struct(F.lit(name).alias("name"), F.array_join(f(_filled(t)), ";").alias("result")) for name, f, t, _ in LISTS]
    return _cases(spark, sf_dir).select("s_suppkey", F.explode(F.array(*each)).alias("x")).select("s_suppkey", "x.name", "x.result")
