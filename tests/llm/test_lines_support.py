"""Support of line templates: lines that recur by themselves take part in it."""

import random
from collections import defaultdict

import pytest

from lodeseam.llm import lines


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute(rows, least=10):
    """Texts that stay, with every line of a leaf in every count."""
    docs = [(d, [x.split() for x in t.split("\n")]) for d, t in rows]
    by_line, leaf, keeper = defaultdict(list), defaultdict(list), {}
    for d, ls in docs:
        for w in {tuple(w) for w in ls}:
            by_line[w].append(d)
    for w, ds in by_line.items():
        leaf[len(w), w[:3]].append((w, ds))
    for members in leaf.values():
        n = defaultdict(list)
        for w, ds in members:
            for p, x in enumerate(w):
                n[p, x] += ds
        groups = defaultdict(lambda: ([], []))
        for w, ds in members:
            t = tuple(x if COUNT(n[p, x]) >= least else None for p, x in enumerate(w))
            if sum(x is not None for x in t) >= 0.6 * len(t):
                groups[t][0].append(w)
                groups[t][1].extend(ds)
        recurring = {t for t, (_, ds) in groups.items() if COUNT(ds) >= least}
        for t, (ws, ds) in groups.items():
            within = [u for u in recurring if all(x is None or x == y for x, y in zip(t, u, strict=True))]
            if within:
                keeper.update(dict.fromkeys(ws, min([*ds, *(min(groups[u][1]) for u in within)])))
    return {d: "\n".join(" ".join(w) for w in ls if keeper.get(tuple(w), d) == d) for d, ls in docs}


def COUNT(ds):
    """Documents, each once."""
    return len(set(ds))


def test_lines_of_one_document_are_no_recurring_template(spark):
    shape = "Mail was sent to {} at noon today"
    names = [chr(97 + k) * 4 for k in range(12)]
    rows = [(1, shape.format("zz")), (2, "\n".join(shape.format(n) for n in names))]
    assert {r.doc_id: r.text for r in lines.clean(table(spark, rows)).collect()} == dict(rows) == brute(rows)
    # ten documents make one, also where each has several of its lines
    rows = [(k, "\n".join(shape.format(f"{n}{chr(97 + k)}") for n in names[:3])) for k in range(10)]
    assert {r.doc_id: r.text for r in lines.clean(table(spark, rows)).collect()} == {0: rows[0][1], **dict.fromkeys(range(1, 10), "")} == brute(rows)
    assert {r.doc_id: r.text for r in lines.clean(table(spark, rows[:9])).collect()} == dict(rows[:9])


@pytest.mark.parametrize("seed", range(2))
def test_several_lines_of_a_leaf_in_a_document_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(["aa", "bb", "cc", rng.choice("ppppqr"), rng.choice("pppq"), f"w{chr(97 + rng.randrange(26))}"]) for _ in range(150)]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.choice([1, 4, 12])))) for k in range(22)]
    want = brute(rows)
    assert {r.doc_id: r.text for r in lines.clean(table(spark, rows)).collect()} == want != dict(rows)


def test_a_hot_spelling_counts_for_its_template(spark):
    words = ["alpha"] * 40 + ["beta", "gamma", "delta", "eps"] * 2
    rows = [(k, f"Shared by user {w} at noon") for k, w in enumerate(words)]
    got = {r.doc_id: r.text for r in lines.clean(table(spark, rows)).collect()}
    assert got == {k: rows[0][1] if k == 0 else "" for k in range(48)} == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_all_lines_of_a_leaf_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(["aa", "bb", rng.choice("xy"), *(rng.choice("pppqr") if rng.random() < 0.8 else f"w{chr(97 + k % 26)}" for _ in range(3))]) for k in range(60)]
    rows = [(k, "\n".join(rng.choices(pool, [1 / (i + 1) for i in range(60)], k=rng.choice([1, 2, 3])))) for k in range(80)]
    assert {r.doc_id: r.text for r in lines.clean(table(spark, rows)).collect()} == brute(rows)
