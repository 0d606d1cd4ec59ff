"""The registered queries, whole, on the smallest tables, against plain versions of their contracts."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from test_operators import brute_fingerprint, brute_hits, brute_substrings, crc, encoded, roots, same
from test_pipeline_brute import without_templates

from lodeseam.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_op2(spark, docs):
    kept = dict(without_templates([(d, t or "") for d, t in docs]))
    want = []
    for d, t in docs:
        lines = [x for x in (t or "").split("\n") if x.split()]
        want.append((d, len(lines), len(lines) - len([x for x in kept[d].split("\n") if x.split()]), hashlib.sha256(kept[d].encode()).hexdigest()))
    same(queries.op2_line_dedup(spark, SF), want, "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sum(x[2] for x in want)


def test_op3(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    first = {}
    for p, b in pages:
        first[b] = min(first.get(b, p), p)
    want = [(p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == p else "revisit", None if first[b] == p else first[b]) for p, b in pages]
    same(queries.op3_warc_index(spark, SF), want, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_op4(spark, docs):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs)
    texts = dict(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    held = [r for r in got if r.held_out and r.lang_pred != "und" and lang[r.doc_id] is not None]
    assert len(held) > 40 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_op5(spark, docs):
    codes = [brute_fingerprint(t) for _, t in docs]
    group = roots(codes)
    ids = defaultdict(list)
    for (d, _), g in zip(docs, group, strict=True):
        ids[g].append(d)
    same(queries.op5_simhash_near_dedup(spark, SF), [(d, f"{c:016x}", min(ids[g])) for (d, _), c, g in zip(docs, codes, group, strict=True)], "doc_id", "fingerprint", "component_id")
    assert any(len(x) > 1 for x in ids.values())


def test_op6(spark, docs):
    want, at = [], 0
    for d, t in sorted(docs):
        ids = [*encoded(t), 0]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    same(queries.op6_token_ids(spark, SF), want, "doc_id", "start", "n_tokens", "ids_crc32")


def test_op7(spark, docs):
    want = brute_substrings(docs, 35)
    same(queries.op7_substring_dedup(spark, SF), want, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sum(x[2] for x in want)


def test_op8(spark, docs):
    want = Counter()
    for d, t in docs:
        ids = [*encoded(t), 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a : a + 1024] if k else ids[:first]
            want[d, k, a, len(part), crc(part)] += 1
    got = queries.op8_best_fit_packing(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(used) <= 1.02 * sum(r.length for r in got) / 1024 + 1


def test_op10(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_hits(docs, items)
    same(queries.op10_decontamination(spark, SF), want, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert any(x[-1] for x in want)
