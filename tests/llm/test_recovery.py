"""A task that is run again has its rows in another order: what they are dealt by must not depend on it."""

import random

from pyspark.sql import functions as F
from test_operators import table

from lodeseam.llm import common, substrings


def test_hot_rows_are_dealt_by_what_they_hold(spark):
    rows = [(k, "hot" if k % 3 else f"key{k}") for k in range(6000)]
    left = table(spark, rows, "a long, k string")
    right = common.save(left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("a").alias("top")), "right")
    met = common.join_hot(left, right, ["k"], "n")
    assert "monotonically_increasing_id" not in met._jdf.queryExecution().toString()
    top = {}
    for a, k in rows:
        top[k] = max(a, top.get(k, a))
    assert sorted((r.a, r.k, r.top) for r in met.collect()) == sorted((a, k, top[k]) for a, k in rows)


def test_passages_whatever_the_order_of_rows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 4)
    rng = random.Random(1)
    shared = [" ".join(f"s{p}w{k}" for k in range(45)) for p in range(3)]
    rows = [(k, " ".join([*(f"own{k}x{j}" for j in range(rng.randrange(30))), shared[k % 3], *(f"end{k}x{j}" for j in range(10))])) for k in range(60)]
    seen = []
    for _ in range(2):
        rng.shuffle(rows)
        got = substrings.report(table(spark, rows).repartition(rng.choice([2, 5])))
        seen.append(sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()))
        assert "monotonically_increasing_id" not in got._jdf.queryExecution().toString()
    assert seen[0] == seen[1] and all(r[2] == 45 for r in seen[0])
