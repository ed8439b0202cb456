"""Merge-on-read against folding the batches one after another; late rows of the consolidation."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.store import _merge
from tidemark.streaming import commands as streams
from tidemark.streaming.merge import MergeTable, merge_stream

KIND = "user_id long, start long, t long, a string, b string, low long, high long, f string, g string"
KEY, RULES = ["user_id", "start"], {"a": "new", "b": "old", "low": "min", "high": "max", "f": "first_new", "g": "first_old"}


def batches(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        keys = {(rng.choice([1, 2, None]), rng.randint(0, 12)) for _ in range(rng.choice([0, 4, 9]))}
        pick = lambda: rng.choice([None, "x", "y", f"z{k}"])
        out.append([(*key, k, pick(), pick(), rng.randint(0, 9), rng.randint(0, 9), pick(), pick()) for key in sorted(keys, key=str)])
    return out


def rows(df):
    return sorted((str(tuple(r[c] for c in [*KEY, *RULES])) for r in df.collect()))


@pytest.mark.parametrize("most", [1, 3, 100])
def test_as_folding_the_batches(spark, tmp_path, most):
    parts = batches(most, 7)
    schema = spark.createDataFrame([], KIND).schema
    table = MergeTable(spark, str(tmp_path / "t"), schema, KEY, RULES, "t", buckets=4, most=most)
    want = spark.createDataFrame([], KIND).select(*KEY, *RULES)
    for number, part in enumerate(parts):
        new = spark.createDataFrame(part, KIND)
        table.write(new, number)
        if number in (2, 5):
            table.write(new, number)  # run again
        want = spark.createDataFrame(_merge(want, new.select(*KEY, *RULES), KEY, RULES).collect(), want.schema)
        if number == 4:
            then = rows(want)
    assert rows(table.read()) == rows(want)
    if most == 100:
        assert rows(table.read(version=4)) == then


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    schema = spark.createDataFrame([], KIND).schema
    table = MergeTable(spark, str(tmp_path / "t"), schema, KEY, RULES, "t", buckets=4, most=2)
    every = [(u, 0, 0, "a", "b", 0, 0, "f", "g") for u in range(4000)]
    table.write(spark.createDataFrame(every, KIND), 0)
    size = lambda p: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(p) for f in fs)
    before = size(tmp_path)
    table.write(spark.createDataFrame([(7, 0, 1, "new", "b", 0, 0, "f", "g")], KIND), 1)
    assert os.listdir(tmp_path / "t" / "base" / "gen=1") and len([d for d in os.listdir(tmp_path / "t" / "base" / "gen=1") if d.startswith("bucket=")]) == 1
    assert size(tmp_path) - before < before * 0.6  # the touched bucket anew, a quarter of the rows
    table.write(spark.createDataFrame([(9, 0, 2, "new", "b", 0, 0, "f", "g")], KIND), 2)
    assert table.read().count() == 4000 and table.read().where("a = 'new'").count() == 2


def test_stream_into_a_table(spark, tmp_path):
    parts = batches(5, 4)
    for i, part in enumerate(parts):
        spark.createDataFrame(part, KIND).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    table = MergeTable(spark, str(tmp_path / "t"), stream.schema, KEY, RULES, "t", buckets=4, most=2)
    merge_stream(stream, table, str(tmp_path / "c")).awaitTermination(120)
    assert table.read().count() == len({r[:2] for p in parts for r in p})


def test_late_commands_are_kept_aside(spark, tmp_path):
    kind = "user_id long, id long, timestamp long, command string"
    done = spark.createDataFrame([], "user_id long, start_time long, end_time long, summary string, commands array<string>")
    at = {"now": 10_000}
    for part in ([(1, 1, 100, "make a"), (1, 2, 160, "make b")], [(1, 3, 120, "make late"), (1, 4, 9000, "make c")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        streams.consolidate_stream(stream, ["user_id"], done, str(tmp_path / "out"), str(tmp_path / "state"), lambda: at["now"], every=None).awaitTermination(120)
        at["now"] += 10_000
    assert [r.command for r in spark.read.parquet(str(tmp_path / "out" / "late")).collect()] == ["make late"]
    assert sorted(r.now for r in spark.read.parquet(str(tmp_path / "out" / "times")).collect()) == [10_000, 20_000]
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).agg(F.count("*")).first()[0] == 2
