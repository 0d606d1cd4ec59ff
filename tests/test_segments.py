import math
import random

from pyspark.sql import functions as F

from lodeseam.functions import extract
from lodeseam.operators import graph
from lodeseam.operators.containment import contained

COUNTS = {"甲": 5.0, "甲乙": 8.0, "乙丙": 9.0, "丙": 1.0, "甲乙丙": 0.5, "丁戊": 2.0, "戊": 3.0, "丁戊己庚": 1.5, "乙": 0.2}


def ways(run):
    """All cuts into words of the dictionary and single characters, as lists of (word, known)."""
    if not run:
        yield []
    for n in range(1, len(run) + 1):
        if run[:n] in COUNTS or n == 1:
            for rest in ways(run[n:]):
                yield [(run[:n], run[:n] in COUNTS), *rest]


def plain(run):
    weight = lambda p: math.log(COUNTS.get(p[0], 1.0)) - math.log(sum(COUNTS.values()))
    best = max(ways(run), key=lambda way: (round(sum(map(weight, way)), 9), [len(w) for w, _ in way]))
    out, loose = [], ""
    for word, known in [*best, ("", True)]:
        if not known:
            loose += word
            continue
        if loose:
            out += [loose] if len(loose) <= 3 else [loose[i : i + 2] for i in range(len(loose) - 1)]
            loose = ""
        out += [word] if word else []
    return out


def test_best_path_against_all_cuts(spark):
    rng = random.Random(3)
    runs = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(n)) for n in range(2, 10) for _ in range(25)] + ["辛壬癸子丑", "丁戊己庚"]
    df = spark.createDataFrame([(r,) for r in runs], "run string")
    got = {r.run: r.words for r in df.select("run", extract.by_weights(COUNTS)(F.col("run")).alias("words")).collect()}
    assert got == {r: plain(r) for r in runs}


def test_tokens_with_the_best_path(spark):
    df = spark.createDataFrame([("甲乙丙 abc 1,234 己",), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(extract.tokens(F.col("text"), segment=extract.by_weights(COUNTS))).collect()]
    assert got == [["甲", "乙丙", "abc", "1234", "己"], [], None]


def test_containment_join_against_the_nested_loop(spark):
    rng = random.Random(7)
    name = lambda: "".join(rng.choice("甲乙丙丁abc") for _ in range(rng.choice([1, 2, 2, 3, 4, 6, 9])))
    inner, outer = [name() for _ in range(1500)] + ["", None, "🎉🎉"], [name() + name() for _ in range(1500)] + ["", None, "x🎉🎉y"]
    a, b = spark.createDataFrame([(x,) for x in inner], "inner string"), spark.createDataFrame([(x,) for x in outer], "outer string")
    df = contained(a, b)
    assert {tuple(r) for r in df.collect()} == {(x, y) for x in set(inner) for y in set(outer) if x and y and x in y}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entity_hits(spark):
    names = spark.createDataFrame([("1", "华星"), ("1", "华星科技"), ("2", "没有"), ("3", "华星科技股份有限公司"), ("4", None)], "qid string, name string")
    keys = spark.createDataFrame([("c1", "华星科技"), ("c2", "华星"), ("c3", "科技")], "chunk_id string, key string")
    got = {(r.qid, r.chunk_id): r.score for r in graph.entity_hits(names, keys).collect()}
    assert got[("1", "c1")] == 4.0 and got[("1", "c2")] == 4.0 and got[("3", "c3")] == 1.0 and not any(q in "24" for q, _ in got)


def test_fixed_words_are_what_a_pattern_each_finds():
    import re

    from lodeseam.operators import entities

    rng, metrics = random.Random(5), ("净利润", "利润", "净利润率", "ABAB", "润率", "", "利润")
    automaton = entities._fixed(metrics)
    brands = re.compile("|".join(entities.BRANDS))
    for _ in range(300):
        text = "".join(rng.choice(["净利润率", "利润", "AB", "率", "安享百万", "医疗", "百万", "国寿福", "x"]) for _ in range(12))
        want = [("metric", m, x.start(), x.end()) for m in dict.fromkeys(metrics) if m for x in re.finditer(re.escape(m), text)] + [("product", x.group(), x.start(), x.end()) for x in brands.finditer(text)]
        assert sorted(entities._words(automaton, text)) == sorted(want)
    assert entities._fixed(()) is not None
