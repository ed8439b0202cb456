"""Sketches of days against exact counts and quantiles."""

import random

from pyspark.sql import functions as F

from tidemark.operators import sketches


def test_ranges_of_days(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b"]), rng.randrange(10 * 86400), f"c{rng.randrange(3000)}", rng.randrange(100_000)) for _ in range(20_000)] + [("a", 5, None, None)]
    df = spark.createDataFrame(rows, "k string, t long, x string, v long")
    days = sketches.day_sketches(df, ["k"], "t", "x", "v")
    assert days.count() == 20 and sketches.day_sketches(df.where("k = 'z'"), ["k"], "t", "x", "v").count() == 0
    for first, last in ((0, 9), (2, 4), (7, 7)):
        day = lambda n: F.lit(f"1970-01-{n + 1:02d}").cast("date")
        for r in sketches.over_days(days, ["k"], day(first), day(last), (0.1, 0.5, 0.9)).collect():
            some = [x for x in rows if x[0] == r.k and first <= x[1] // 86400 <= last]
            exact, values = len({x[2] for x in some if x[2]}), sorted(x[3] for x in some if x[3] is not None)
            assert r.n == len(some) and abs(r.about - exact) <= 0.03 * exact
            for q, got in zip((0.1, 0.5, 0.9), r.quantiles):
                assert abs(sum(v <= got for v in values) / len(values) - q) < 0.03
