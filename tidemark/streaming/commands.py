"""Streams of commands: sessions, duplicates, and idempotent batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.store import consolidate


def stream_sessions(commands: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream with an event time ``ts``; they end at their last command, and a gap of exactly ``gap`` joins.

    A window of the session needs a key beside it, so ``keys`` must not be
    empty. State is kept until ``late`` after a session could still grow.
    """
    if not keys:
        raise ValueError("a stream of sessions needs keys")
    rows = commands.withWatermark("ts", late)
    return rows.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_commands")).drop("w")


def stream_distinct(commands: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each command at a time once, as long as its repeats come within ``late``."""
    return commands.withWatermark("ts", late).dropDuplicatesWithinWatermark([*keys, "ts", "command"])


def upsert_stream(stream: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Fold each micro-batch into the table at ``target`` with ``merge(old, new)``.

    A batch writes the version with its own number, from the version before, so
    a batch that is run again gives the same table. Without ``every`` the query
    takes what is there and stops.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(empty.schema).parquet(f"{target}/v{number}") if number else empty
        merge(old, batch).write.mode("overwrite").parquet(f"{target}/v{number + 1}")

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def consolidate_stream(stream: DataFrame, keys: list[str], done: DataFrame, target: str, checkpoint: str, now: Callable[[], int], every: str | None = "300 seconds") -> StreamingQuery:
    """Consolidate idle chunks after each micro-batch, into ``target``/chunks, a folder for each batch.

    Beside the chunks, a batch leaves the commands that are in none yet and the
    high-water mark of each key, starting from that of ``done``; the next one
    reads only these. Commands that come at or before their key's mark are in no
    chunk: they are kept in ``target``/late, a folder for each batch, from which
    ``resession`` can make chunks anew. The time at which a batch is taken up is
    kept too, so a batch that is run again writes the same folders.
    """
    stream.sparkSession.createDataFrame([], "batch long, now long").write.mode("ignore").parquet(f"{target}/times")

    def time_of(spark: SparkSession, number: int) -> int:
        times = spark.read.schema("batch long, now long").parquet(f"{target}/times")
        known = times.where(F.col("batch") == number).agg(F.min("now")).first()[0]
        if known is None:
            known = now()
            spark.createDataFrame([(number, known)], "batch long, now long").write.mode("append").parquet(f"{target}/times")
        return known

    def fold(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        marked = done.select(*keys, "end_time")
        marks = spark.read.schema(marked.schema).parquet(f"{target}/marks/v{number}") if number else marked
        waiting = spark.read.schema(batch.schema).parquet(f"{target}/waiting/v{number}") if number else batch.limit(0)
        seen = waiting.unionByName(batch)
        late = batch.join(marks.withColumnRenamed("end_time", "__mark"), keys).where(F.col("timestamp") <= F.col("__mark")).drop("__mark")
        late.write.mode("overwrite").parquet(f"{target}/late/batch={number}")
        consolidate(seen, marks, keys, time_of(spark, number)).write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        fresh = spark.read.parquet(f"{target}/chunks/batch={number}").select(*keys, "end_time")
        latest = marks.unionByName(fresh).groupBy(*keys).agg(F.max("end_time").alias("end_time"))
        latest.write.mode("overwrite").parquet(f"{target}/marks/v{number + 1}")
        upto = spark.read.schema(marked.schema).parquet(f"{target}/marks/v{number + 1}").withColumnRenamed("end_time", "__mark")
        same = [seen[k].eqNullSafe(upto[k]) for k in keys]
        open_ = seen.join(upto, reduce(Column.__and__, [*same, seen["timestamp"] <= upto["__mark"]]), "left_anti")
        open_.write.mode("overwrite").parquet(f"{target}/waiting/v{number + 1}")

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
