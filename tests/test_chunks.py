"""The stateful chunks against the batch operator, in any order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.sessions import idle_chunks
from tidemark.streaming import chunks

KIND = "user_id long, timestamp long, id long, command string"


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, 3]), 1_000_000 + rng.randint(0, 40_000), i, f"c{i}") for i in range(120)]
    rng.shuffle(rows)  # all within the allowed delay
    last = [(1, 3_000_000, 9999, "last")]
    for n, part in enumerate([rows[:50], rows[50:90], rows[90:], last, [(2, 3_000_001, 9998, "last")]]):
        spark.createDataFrame(part, KIND).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", chunks.ROCKS)
    try:
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withColumn("ts", F.timestamp_seconds("timestamp"))
        out = chunks.stream_chunks(stream, ["user_id"], 600, "12 hours")
        q = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = idle_chunks(spark.createDataFrame(rows, KIND), ["user_id"], 3_000_000, 600)
    want = found.groupBy("user_id", "session_id").agg(F.min("timestamp").alias("s"), F.max("timestamp").alias("e"), F.count("*").alias("n")).collect()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.user_id, r.start_time, r.end_time, r.n_commands) for r in got) == sorted((r.user_id, r.s, r.e, r.n) for r in want)
    assert sum(len(r.commands) for r in got) == len(rows)
