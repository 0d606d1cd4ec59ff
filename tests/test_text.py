from pyspark.sql import functions as F

from lodeseam.functions import extract, text


def one(spark, column, **values):
    return spark.createDataFrame([values], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_phrase_keys_are_cut_runs_not_parts(spark):
    run = "营业收入增长情况说明以及其他重要事项提示内容甲乙丙丁戊"  # 25 characters
    assert one(spark, extract.phrase_keys(F.col("t")), t=run) == [run[:20], run[20:]]


def test_number_keys_of_latex_and_commas(spark):
    keys = one(spark, extract.number_keys(F.col("t")), t=r"\(43.24\%\) 和 1,234.5，约10亿元")
    assert {"43.24", "43.24%", "1234.5", "10", "10亿元"} <= set(keys)


def test_converted_keys_use_double_arithmetic(spark):
    assert one(spark, extract.converted(F.col("t")), t="374.48") == ["374.48", "37448", "3744800", "374480000"]
    assert one(spark, extract.converted(F.col("t")), t="0.29")[1] == "28"
    assert one(spark, extract.converted(F.col("t")), t="29") == ["29"]


def test_amounts_are_numbers(spark):
    assert sorted(one(spark, extract.amounts(F.col("t")), t="10亿元与150万元")) == [1.5e6, 1e9]


def test_graph_numbers_skip_years(spark):
    assert set(one(spark, extract.graph_numbers(F.col("t")), t="2024年 345 人，12,345 元 5%")) >= {"345", "12345", "5%"}
    assert "2024" not in one(spark, extract.graph_numbers(F.col("t")), t="2024年")


def test_html_to_text(spark):
    assert one(spark, text.html_to_text(F.col("t")), t="<table><tr><td>a</td><td>b</td></tr>\n\n<tr><th>c&amp;</th></tr></table>") == "| a | b\n | c&amp;"


def test_normalize_entity(spark):
    assert one(spark, text.normalize_entity(F.col("t")), t="比亚迪股份有限公司") == "比亚迪"
    assert one(spark, text.normalize_entity(F.col("t")), t="集团") == "集团"


def test_normalize_latex(spark):
    assert one(spark, text.normalize_latex(F.col("t")), t=r"占比 \( 43.24\% \)，10 亿元") == "占比43.24%，10亿元"


def test_excerpt_and_number_excerpt(spark):
    assert one(spark, text.excerpt(F.col("t"), F.lit("X"), 4), t="aaaaXbbbb") == "...aaXbb..."
    assert one(spark, text.excerpt(F.col("t"), F.lit("Z"), 4), t="aaaaXbbbb") == "aaaa"
    assert "12,345" in one(spark, text.excerpt_number(F.col("t"), F.lit("12345"), 20), t="x" * 50 + "12,345" + "y" * 50)


def test_document_of_takes_the_last_mark(spark):
    assert one(spark, text.document_of(F.col("t")), t="a_cb_c12") == "a_cb"


def test_keywords_longest_first(spark):
    assert one(spark, extract.cjk_keywords(F.col("t")), t="营收，净利润，总资产合计") == ["总资产合计", "净利润", "营收"]


def test_citations(spark):
    assert one(spark, extract.citations(F.col("t")), t="见[证据12]与[证据 1]、[证据1]") == [1, 12]


def test_tokens_of_cjk_are_pairs(spark):
    assert one(spark, extract.tokens(F.col("t")), t="The 1,234.5 营业收入 a") == ["the", "1234.5", "营业", "业收", "收入", "a"]


def test_null_text_gives_null_or_empty(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(extract.number_keys(F.col("t"))).first()[0] in (None, [])
    assert df.select(text.html_to_text(F.col("t"))).first()[0] is None


def test_cases_of_suppliers_with_long_numbers(spark, tmp_path):
    import duckdb

    from lodeseam.plans import queries

    table = spark.createDataFrame([(k,) for k in (0, 6999, 7000, 59999, 997000)], "s_suppkey long")
    table.write.parquet(f"{tmp_path}/supplier.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    for name in ("text_functions", "option_checks"):
        got = {(r.s_suppkey, r.name, r.result) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == set(db.execute(queries.ORACLE[name]).fetchall())
