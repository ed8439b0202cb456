"""Segmented scans against windows, with one key over many parts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import scan, sessions


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small tables in as many parts as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def logs(spark, seed, users):
    rng = random.Random(seed)
    rows = [(rng.choice(users), rng.choice([rng.randint(0, 400_000), rng.randint(0, 3000), 77]), i, rng.choice([None, 1, 2])) for i in range(600)]
    return spark.createDataFrame(rows, "user_id long, timestamp long, id long, v int").repartition(5)


@pytest.mark.parametrize("users", [[1], [1, 1, 1, 2, None, 3], list(range(300))])
def test_scan_is_a_window(spark, users):
    rows, order = logs(spark, 1, users), ["timestamp", "id"]
    parts = scan.parted(rows, ["user_id"], order)
    assert parts.select(scan.PART).distinct().count() > 1
    w = Window.partitionBy("user_id").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    got = scan.scan(parts, ["user_id"], order, {"p": F.col("v")}, {"r": F.col("v")}, {"l": F.col("v")}, {"h": F.col("v")}).drop(scan.PART)
    want = rows.select("*", F.lag("v").over(w).alias("p"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("r"), F.last("v", True).over(upto).alias("l"), F.max("v").over(upto).alias("h"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    places = scan.numbered(rows, ["user_id"], order).collect()
    assert sorted((r.user_id or -1, r.place) for r in places) == sorted((r.user_id or -1, r.n) for r in rows.select("user_id", (F.row_number().over(w) - 1).alias("n")).collect())


@pytest.mark.parametrize("keys", [[], ["user_id"]])
@pytest.mark.parametrize("inclusive", [False, True])
def test_sessions_of_a_heavy_user(spark, keys, inclusive):
    rows = logs(spark, 2, [1, 1, 1, 1, 2])
    plain, spread = (sessions.assign_sessions(rows, keys, 300, inclusive, spread=s) for s in (False, True))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, spread.select(plain.columns).collect()), key=str)
    plain, spread = (sessions.idle_chunks(rows, keys, 400_000, 300, spread=s) for s in (False, True))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, spread.select(plain.columns).collect()), key=str)


def test_gaps_of_a_heavy_user(spark):
    rows = sessions.assign_sessions(logs(spark, 3, [1, 1, 2]).withColumn("project_id", F.lit(1)).withColumn("is_legacy", F.lit(False)), ["user_id"], 300)
    found = sessions.session_rows(rows, ["user_id"])
    for run in (sessions.long_gaps, sessions.inferred_breaks):
        plain, spread = (run(found, ["user_id"], 900, spread=s) for s in (False, True))
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, spread.select(plain.columns).collect()), key=str)


def test_scans_of_empty_tables(spark):
    empty = logs(spark, 4, [1]).where("id < 0")
    assert scan.numbered(empty, ["user_id"], ["timestamp", "id"]).count() == 0
    assert sessions.assign_sessions(empty, ["user_id"], spread=True).count() == 0
