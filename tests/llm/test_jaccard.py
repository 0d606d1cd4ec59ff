"""The n-gram Jaccard join against brute force over all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from test_operators import clash, odd_rows, same, table

from lodeseam.llm import jaccard, queries

SF = "/root/testdata/sf0.001"


def sets_of(text, size):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def plain(rows, size=5, percent=80):
    held = [sets_of(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(held):
        for j in range(i):
            if a and 100 * len(a & held[j]) >= percent * len(a | held[j]):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    first = lambda i: min((d for d in ids[find(i)] if d is not None), default=None)
    return [(d, len(held[i]), first(i)) for i, (d, _) in enumerate(rows)]


def check(spark, rows, **how):
    same(jaccard.near_duplicates(clash(table(spark, rows), "n", "a", "root", "kind"), **how), plain(rows, **how), "doc_id", "n_shingles", "component_id")


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def crowd(rng, n, words=200, most=9):
    """Copies of one text with some words changed: some are similar to the text only, some to each other, some to none."""
    base = [f"w{k}" for k in range(words)]
    return [" ".join(base)] + [changed(rng, base, rng.randint(0, most)) for _ in range(n)]


def passages(rng, n):
    """Texts that share a long passage, which alone makes them similar or not, and chains of texts that drift apart."""
    common = " ".join(f"p{k}" for k in range(150))
    out = [common + " " + " ".join(f"own{rng.random()}" for _ in range(rng.choice([2, 14, 30, 45, 60]))) for _ in range(n)]
    walk = [f"c{k}" for k in range(120)]
    for k in range(n):
        walk[(7 * k) % 120] = f"step{k}"
        out.append(" ".join(walk))
    return out


def test_odd_rows(spark):
    rows = odd_rows()
    rows += [(300, "one two three"), (301, "One two  three"), (302, "one two three four"), (303, "one two three one two three one two three")]
    check(spark, rows)
    check(spark, rows, size=2, percent=60)
    assert jaccard.near_duplicates(table(spark, [])).count() == 0
    assert jaccard.near_duplicates(table(spark, [(1, None), (None, "")])).count() == 2
    with pytest.raises(ValueError):
        jaccard.near_duplicates(table(spark, []), percent=40)


@pytest.mark.parametrize(("block", "common", "gather", "pairs"), [(32, 64, 1 << 20, 1 << 22), (16, 3, 700, 1), (4, 2, 300, 4000)])
def test_crowds(spark, monkeypatch, block, common, gather, pairs):
    """Groups of near copies, passages and drifting chains: at the usual sizes, and with blocks, gatherings and steps so
    small that groups take many steps, n-grams are common everywhere and sets come from several gatherings."""
    for name, value in (("BLOCK", block), ("COMMON", common), ("GATHER", gather), ("PAIRS", pairs), ("RANGE", 2000)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(block + gather)
    texts = crowd(rng, 60) + passages(rng, 25) + crowd(rng, 25, 30, 2)
    rows = [(k, t) for k, t in enumerate(texts)] + [(500 + k, texts[3]) for k in range(30)]
    rng.shuffle(rows)
    want = plain(rows)
    assert len({w[2] for w in want}) < 90
    check(spark, rows)


def test_groups_that_stay_apart_meet_in_full(spark, monkeypatch):
    """Two families within one group of a common n-gram, linked by one pair in the middle that no star has."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "PAIRS", 1)
    made = []
    linked = jaccard.Sets.linked
    monkeypatch.setattr(jaccard.Sets, "linked", lambda self, pairs: made.append(pairs.count()) or linked(self, pairs))
    walk, rows = [f"c{k}" for k in range(100)], []
    for k in range(24):
        walk[(4 * k + 2) % 100] = f"s{k}"
        walk[(4 * k + 52) % 100] = f"t{k}"
        rows.append((k, " ".join(walk)))
    check(spark, rows)
    assert len(made) > 1


def test_hot_ngrams_do_not_gather(monkeypatch):
    """An n-gram of every document makes one row with a number in its range, whatever the number of documents."""
    monkeypatch.setattr(jaccard, "GATHER", 1 << 30)
    import pyarrow as pa

    texts = [f"always the same five words {k} and more of {k * k} here" for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], names=["doc_id", "text"])
    rows = [r for b in jaccard._dealt([batch], 0, 5, 3) for r in b.to_pylist()]
    segments = [r for r in rows if r["kind"] == jaccard.SEGMENT]
    marks = [r for r in rows if r["kind"] == jaccard.MARK]
    assert len(segments) == len(marks) == 1 and len(marks[0]["data"]) == 6
    assert len(segments[0]["data"]) // 6 + 2000 == sum(r["n"] for r in rows if r["kind"] == jaccard.DOCUMENT)
    shared = [r for r in rows if r["kind"] == jaccard.SHARED]
    assert len(shared) == 1 and len(shared[0]["owners"]) // 2 == len(shared[0]["data"]) // 8 == 2000


@pytest.mark.parametrize("bits", [0, 1, 7, 16, 20])
def test_hashes_come_back_from_their_ranges(bits):
    h = np.unique(np.random.default_rng(bits).integers(0, 1 << 64, 500, np.uint64))
    part = [int(x) >> (64 - bits) for x in h]
    back = [int(jaccard._known(jaccard._bytes(np.array([x]), bits), k, bits)[0]) for x, k in zip(h, part, strict=True)]
    assert back == [int(x) >> max(0, 16 - bits) << max(0, 16 - bits) for x in h]


def test_op13(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(rows)
    same(queries.op13_ngram_jaccard_join(spark, SF), want, "doc_id", "n_shingles", "component_id")
    assert len({w[2] for w in want}) < len(want)


def test_tables_of_done_steps_are_removed(spark):
    from lodeseam.llm import common, jaccard

    before = common.made()
    docs = spark.createDataFrame([(i, "a b c d e f g h i j" + (" k" if i == 2 else "")) for i in range(4)] + [(9, "z")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    left = {path.rsplit("/", 1)[1].split("-")[0] for path in common.made() - before}
    assert not left & {"counted", "sets", "prefixes", "groups"}
