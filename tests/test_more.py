"""Dictionary segmenter, answers out of texts, walks over the graph, and small readers and writers."""

import heapq
import json
import random

import pytest
from pyspark.sql import functions as F

from lodeseam.functions import extract
from lodeseam.operators import graph, judge, postings, search, sizes
from lodeseam.service import Service
from lodeseam.sources import ingest, sinks


def one(spark, column, *values):
    names = [f"v{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("资产负债合计为", ["资产", "负债合计", "为"]),
        ("招商永隆银行营业收入", ["招商永隆银行", "营业收入"]),
        ("我们认为应该这样", ["我们", "们认", "认为", "为应", "应该", "该这", "这样"]),
        ("Revenue 1,234 净利润", ["revenue", "1234", "净利润"]),
        ("", []),
    ],
)
def test_dictionary_segmenter(spark, text, want):
    cut = extract.by_dictionary((*extract.DICTIONARY, "负债合计"))
    assert one(spark, lambda t: extract.tokens(t, segment=cut), text) == want


def test_segmenter_in_the_ranking(spark):
    chunks = spark.createDataFrame([("d", "a", "1", "营业收入增长"), ("d", "a", "2", "收入与营业"), ("d", "b", "3", "其他")], "domain string, doc_id string, chunk_id string, text string")
    q = spark.createDataFrame([("q", "d", "营业收入")], "qid string, domain string, question string")
    found = lambda **k: {r.chunk_id for r in search.bm25(chunks, q, synonyms={}, **k).collect()}
    assert found() == {"1", "2"} and found(segment=extract.by_dictionary()) == {"1"}
    tf = postings.term_frequency(chunks, segment=extract.by_dictionary())
    assert found(tf=tf, segment=extract.by_dictionary()) == {"1"}


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("分析。答案：C、A", "multi", "AC"), ("我选B", "mcq", "B"), ("因此\n  ABD \n完", "multi", "ABD"), ("正确的选项应为 A 和 D", "multi", "AD"), ("选项c 较好", "mcq", "C"),
        ("答案: 无\n选 d", "mcq", "D"), ("说法支持", "tf", "A"), ("不清楚", "tf", "B"), ("不清楚", "mcq", ""), ("", "tf", ""), (None, "mcq", ""),
    ],
)
def test_answer_by_cascade(spark, text, kind, want):
    assert one(spark, judge.answer_by_cascade, text, kind) == want


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("答案是cb", "multi", "BC"), ("答案：CB", "mcq", "C"), ("我选 D。", "mcq", "D"), ("一\n所以 BA\n", "multi", "AB"), ("一\n所以 BA\n", "mcq", "B"), ("这一说法正确。", "tf", "A"),
        ("说法错误。", "tf", "B"), ("只有 C 成立。", "mcq", "C"), ("C、B成立。", "multi", "C"), ("无。", "multi", "AB"), ("无。", "mcq", "A"), (None, "mcq", "A"), ("xAy。", "mcq", "A"),
    ],
)
def test_answer_of_reasoning(spark, text, kind, want):
    assert one(spark, judge.answer_of_reasoning, text, kind) == want


def test_answers_by_priority(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "qid string, answer string")
    items = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "qid string")
    got = judge.by_priority(items, [("file", rows(("1", "A"), ("2", ""))), ("model", rows(("2", "B"), ("1", "C"))), ("retrieval", rows(("3", "D")))]).collect()
    assert {r.qid: (r.answer, r.method) for r in got} == {"1": ("A", "file"), "2": ("B", "model"), "3": ("D", "retrieval"), "4": (None, None)}


def walked(starts, edges, most):
    heap = [(-s, c, 0) for c, s in starts]
    heapq.heapify(heap)
    out, seen = [], set()
    while heap and len(out) < most:
        s, c, depth = heapq.heappop(heap)
        if c in seen:
            continue
        seen.add(c)
        out.append((c, round(-s, 9), depth))
        for a, b, relation in edges:
            if a == c and b not in seen:
                heapq.heappush(heap, (s * graph.DECAYS.get(relation, graph.OTHER_DECAY), b, depth + 1))
    return out


def test_best_first_walk(spark):
    rng = random.Random(5)
    edges = [(f"n{k:02d}", f"n{k + 1:02d}", "next_chunk") for k in range(39)] + [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}", rng.choice(["prev_chunk", "mentioned_in", "contains"])) for _ in range(60)]
    edges = list({(a, b): (a, b, r) for a, b, r in edges}.values())
    starts = {"p": [("n00", 1.0), ("n20", 0.73)], "q": [("n05", 3.1)]}
    df = spark.createDataFrame([(q, c, s) for q, rows in starts.items() for c, s in rows], "qid string, chunk_id string, score double")
    for most in (3, 12, 200):
        got = {}
        for r in graph.best_first(df, spark.createDataFrame(edges, "src string, dst string, relation string"), most).orderBy("qid", "place").collect():
            got.setdefault(r.qid, []).append((r.chunk_id, round(r.score, 9), r.depth))
        assert got == {q: walked(rows, edges, most) for q, rows in starts.items()}
    with pytest.raises(ValueError):
        graph.best_first(df, df, decays={"x": 1.0})


def test_several_documents_by_one_name(spark):
    q = spark.createDataFrame([("1", ["fr_multi_byd_catl", "x"]), ("2", ["x"]), ("3", None)], "qid string, doc_ids array<string>")
    got = {r.qid: r.doc_ids for r in ingest.resolved(q).collect()}
    assert got == {"1": ["annual_byd_2025_report", "annual_catl_2025_report", "x"], "2": ["x"], "3": None}


def test_document_texts(spark, tmp_path):
    doc = {"doc_id": "d", "pages": [{"page_num": 1, "text": "一 \\( 5\\% \\)"}, {"page_num": 2, "text": ""}], "tables": [{"page": 2, "markdown": "|x|"}]}
    (tmp_path / "d.json").write_text(json.dumps(doc), encoding="utf-8")
    docs = ingest.documents(spark, str(tmp_path))
    text = lambda **k: ingest.document_text(docs, **k).first().text
    assert text() == "一 \\( 5\\% \\)\n" and text(tables_first=True) == "|x|\n一 \\( 5\\% \\)" and text(normalised=True).startswith("一5%")
    chunks = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a")], "doc_id string, chunk_no int, text string")
    assert text(chunks=chunks).endswith("\na\nb")


def test_trace(spark):
    ranked = spark.createDataFrame([("1", "c", "d", 2.0, "t" * 200, 1)], "qid string, chunk_id string, doc_id string, score double, text string, rank int")
    q = spark.createDataFrame([("1", "x" * 300), ("2", "y")], "qid string, question string")
    got = {r.qid: json.loads(r.trace) for r in sinks.retrieval_trace(q, ranked, {"symbolic_recall": ranked.select("qid", "chunk_id")}).collect()}
    assert len(got["1"]["question"]) == 200 and got["1"]["symbolic_recall_count"] == 1 and got["1"]["top_chunks"][0]["text_preview"] == "t" * 100
    assert got["2"]["symbolic_recall_count"] == 0 and "top_chunks" not in got["2"]


def test_stated_sets_are_scanned_in_blocks(spark):
    queries = spark.createDataFrame([(str(k), f"w{k} ") for k in range(30)], "qid string, keyword string")
    rows = spark.createDataFrame([(k, "".join(f"w{x} " for x in range(k))) for k in range(30)], "chunk_id int, text string")
    found = lambda most: sorted((r.qid, r.chunk_id) for r in sizes.scan(queries, rows, F.contains("text", F.col("keyword")), most=most).collect())
    assert found(1 << 20) == found(300) and len(found(300)) == sum(range(30))


def test_service_gives_back_its_tables(spark):
    chunks = spark.createDataFrame([("d", "a", "1", 0, "apple pie", False, 1)], "domain string, doc_id string, chunk_id string, chunk_no int, text string, has_table boolean, page int")
    with Service(chunks) as s:
        assert s.handle("GET", "/search", {"question": "apple", "domain": "d"})[0] == 200 and s.chunks.storageLevel.useMemory
    assert not s.chunks.storageLevel.useMemory
