from pyspark.sql import functions as F

from lodeseam.operators import chunking
from lodeseam.sources import ingest


def test_pack_drops_short_buffers(spark):
    df = spark.createDataFrame([("\n\n".join(["a" * 60, "b" * 30, "c" * 90, "d" * 5]),)], "t string")
    got = df.select(chunking.pack_paragraphs(F.col("t"), 100, 20).alias("c")).first().c
    assert [(x.text, x.start) for x in got] == [("a" * 60 + "\n" + "b" * 30, 0), ("c" * 90 + "\n" + "d" * 5, 92)]


def test_clause_pieces(spark):
    long = "第二条 " + "x" * 60
    df = spark.createDataFrame([("第一条 甲\n" + long + "\n第三条 丙\n第四条 丁",)], "t string")
    got = df.select(chunking.clause_pieces(F.col("t"), 50).alias("c")).first().c
    assert any("x" * 60 in p for p in got) and got[-1].endswith("第四条 丁") and "第三条 丙" in got[-1]
    assert df.select(chunking.clause_pieces(F.lit("short"), 50)).first()[0] == ["short"]


def documents(spark, tmp_path, blocks, text=""):
    import json

    path = tmp_path / "annual_1.json"
    path.write_text(json.dumps({"doc_id": "annual_1", "pages": [{"page": 3, "text": text, "blocks": blocks}], "tables": [{"page_num": 3, "markdown": "| m | 1 |"}, {"page": 3, "markdown": ""}]}, ensure_ascii=False))
    (tmp_path / "broken.json").write_text("{")
    return ingest.documents(spark, str(tmp_path / "*.json"))


def test_reader_injects_tables_and_skips_broken_files(spark, tmp_path):
    df = documents(spark, tmp_path, [{"type": "text", "text": "hello"}])
    rows = ingest.page_rows(df).collect()
    assert len(rows) == 1 and rows[0].page_num == 3 and rows[0].domain == "financial_reports"
    assert [b.type for b in rows[0].blocks] == ["text", "table"]
    assert ingest.document_text(df, tables_first=True).first().text.startswith("| m | 1 |")


def test_overlap_only_before_a_table(spark, tmp_path):
    df = documents(spark, tmp_path, [{"type": "text", "text": "t" * 300}, {"type": "table", "markdown": "| a | b |"}, {"type": "text", "text": "after"}])
    got = chunking.chunks(df, "blocks").orderBy("chunk_no").collect()
    assert [c.has_table for c in got][:4] == [False, True, False, True]  # the injected table comes last
    assert got[1].text.startswith("[表格 - 第3页]\n") and got[2].text == "t" * 200 + "\nafter"


def test_domain_strategy_without_blocks(spark, tmp_path):
    import json

    (tmp_path / "9.json").write_text(json.dumps({"doc_id": "9", "pages": [{"page_num": 1, "text": "a" * 60 + "\n\n" + "b" * 10}]}))
    got = chunking.chunks(ingest.documents(spark, str(tmp_path / "9.json"))).collect()
    assert [(c.chunk_id, c.text, c.domain) for c in got] == [("9_c0", "a" * 60, "insurance")]


def test_positions(spark):
    df = spark.createDataFrame([("d", k) for k in range(10)], "doc_id string, chunk_no int")
    got = [r.chunk_position for r in chunking.positions(df).orderBy("chunk_no").collect()]
    assert got == ["head"] * 2 + ["body"] * 6 + ["tail"] * 2
    assert chunking.positions(df.limit(1)).first().chunk_position == "head"


def test_nearby_pages(spark):
    pages = [(k, f"p{k}") for k in range(1, 12)]
    docs = spark.createDataFrame([("d", "x", [(n, t, []) for n, t in pages])], "doc_id string, domain string, pages array<struct<page_num: int, text: string, blocks: array<struct<type: string, text: string, html: string, markdown: string, latex: string, lines: array<struct<text: string>>>>>>")
    got = ingest.nearby_pages(docs, spark.createDataFrame([("d", 2)], "doc_id string, page int"), 2).first().text
    assert [x for x in got.split("\n") if x] == ["p1", "p2", "p3", "p4"]
