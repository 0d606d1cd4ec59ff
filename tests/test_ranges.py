import random

from lodeseam.operators import ranges


def test_near_against_the_nested_loop(spark):
    rng = random.Random(1)
    points = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 40)]), k) for k in range(300)]
    wanted = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-40, 40)])) for _ in range(60)]
    p, w = spark.createDataFrame(points, "doc string, page int, id int"), spark.createDataFrame(wanted, "doc string, around int")
    for radius in (0, 1, 5, 100):
        df = ranges.near(p, w, ["doc"], "page", "around", radius)
        want = sorted((d, r, i) for d, r in wanted for e, x, i in points if d == e is not None and r is not None and x is not None and abs(r - x) <= radius)
        assert sorted((r.doc, r.around, r.id) for r in df.select("doc", "around", "id").collect()) == want
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
