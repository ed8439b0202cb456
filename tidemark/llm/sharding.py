"""Sharding by sampled splitters, with sizes as equal as whole records allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import written

CELL_BITS = 16  # the key space is cut into 65,536 cells, whatever the input's size
SAMPLE = 200_000  # expected size-weighted draws for the splitters
RANGE_ROWS = 50_000  # rows aimed at in one range
OVERFULL = 2  # a range of more than this many times the mean size is subdivided
RECORD_BYTES = 16  # what a record takes besides its text


def _splitters(keyed: DataFrame, rows: int, size: int, ranges: int) -> list[int]:
    """Quantiles of the key cells, each record drawn with chances in proportion to its size."""
    draws = F.col("size") * F.lit(SAMPLE / max(1, size))
    chance = F.pmod(F.xxhash64(F.lit("draw"), "key", "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = (F.floor(draws) + (chance < draws - F.floor(draws)).cast("long")).alias("times")
    drawn = keyed.select("cell", times).where("times > 0")
    at = [i / ranges for i in range(1, ranges)]
    found = drawn.agg(F.percentile("cell", F.array(*map(F.lit, at)), F.col("times")).alias("q")).first()["q"] if at else []
    return sorted({int(x) for x in found or []})


def _ranges(spark, splitters: list[int]) -> DataFrame:
    """(cell, range) of all cells: at most 65,536 rows."""
    bounds = F.array(*map(F.lit, splitters)) if splitters else F.array().cast("array<int>")
    return spark.range(1 << CELL_BITS).select(F.col("id").cast("int").alias("cell"), F.size(F.filter(bounds, lambda b: b < F.col("id"))).alias("range"))


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + RECORD_BYTES


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Put each record into a shard so that the shards' bytes are near equal.

    Returns one row per input row: ``id_col``, size (UTF-8 bytes plus 16),
    text_crc32, shard and slot (gapless from 0 within the shard). Records are
    ordered by a hash of their text and by id, so that equal texts are
    neighbours and share a shard unless it ends among them. Splitters drawn
    from a size-weighted sample cut that order into ranges; a range holding a
    hot text or very long ones is subdivided by a hash of the id; the exact
    bytes before each range then give every record its place, so a shard is
    off the mean by one record at most.

    A null text has no bytes and the crc32 of the empty text. Null ids come
    first; repeated rows are records of their own, in an arbitrary order among
    themselves. Columns named in ``keep`` are carried along, others ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    carried = F.struct(*[F.col(c) for c in keep]).alias("carried") if keep else F.lit(0).alias("carried")
    keyed = written(
        docs.select(carried, F.col(id_col).alias("id"), record_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"))
        .withColumn("cell", F.shiftrightunsigned("key", 64 - CELL_BITS).cast("int")),
        "keyed",
    )
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(1 << 12, max(4, rows // RANGE_ROWS))
    ranged = keyed.join(F.broadcast(_ranges(spark, _splitters(keyed, rows, total, ranges))), "cell")
    load = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("bytes") / F.lit(OVERFULL * max(1, total) / ranges)), F.ceil(F.col("n") / F.lit(OVERFULL * max(1, rows) / ranges)))
    load = load.select("range", F.when(parts > 1, parts * 2).otherwise(1).alias("parts"))
    placed = ranged.join(F.broadcast(load), "range").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), "parts"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("range", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    starts = starts.select("range", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"))
    inside = Window.partitionBy("range", "part").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    ordered = (
        placed.join(F.broadcast(starts), ["range", "part"])
        .withColumn("row", F.col("row0") + F.coalesce(F.count("*").over(inside), F.lit(0)))
        .withColumn("byte", F.col("byte0") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("shard", F.least(F.floor((F.col("byte") + F.col("size") / 2) * shards / F.lit(max(1, total))), F.lit(shards - 1)).cast("int"))
        .select("id", "size", "text_crc32", "shard", "row", "carried")
    )
    ordered = written(ordered, "ordered")
    first = ordered.groupBy("shard").agg(F.min("row").alias("row1"))
    return ordered.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("row1")).alias("slot"), *[F.col(f"carried.`{c}`") for c in keep])
