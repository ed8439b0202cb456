"""Exact deduplication by two passes over a counting Bloom filter of text digests.

The filter is blocked: a digest has one block and, in each of the block's two
lanes, one cell. A lane is a number of CELLS counters of BITS bits, so adding
rows is a plain ``sum``, which Spark starts before the shuffle. A digest that
occurs twice has counters of two or more in both lanes; so has about one in
forty that occurs once. What counters overflow into can only be marked more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written

CELLS, BITS = 12, 5  # of a lane
ROWS_PER_BLOCK = 1.5
SENT_WORDS = 1_000_000  # marked blocks sent to every task at a time (about 40 MB); a larger filter is sent in slices, each to the rows of its blocks
HOT_ROWS = 10_000  # rows of a group from which it is sent to the tasks instead of its rows to one task
HOT_GROUPS = 1_000_000  # at most, as larger inputs have larger hot groups
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null counts as empty.

    ``lower`` is right for pure ASCII and much faster than ``translate``.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _located(hashed: DataFrame, rows: int) -> DataFrame:
    """Adds the block of each digest and its cell in either lane."""
    cells = F.xxhash64(F.lit("cells"), "text_sha256")
    block = F.pmod(F.xxhash64("text_sha256"), F.lit(int(rows / ROWS_PER_BLOCK) + 1))
    return hashed.withColumns({"block": block, "left": F.pmod(cells, F.lit(CELLS)), "right": F.pmod(F.shiftrightunsigned(cells, 32), F.lit(CELLS))})


def repeated_filter(located: DataFrame) -> DataFrame:
    """(block, mask): the cells of each lane that at least two rows fall into, where both lanes have one.

    A block with so many rows that a counter may have overflowed is marked as a whole.
    """
    one = lambda lane: F.try_sum(F.expr(f"shiftleft(1L, cast({BITS} * {lane} as int))"))
    blocks = located.groupBy("block").agg(one("left").alias("left"), one("right").alias("right"), F.count("*").alias("n")).where("n > 1")
    cell = lambda lane, i: F.shiftright(F.col(lane), BITS * i).bitwiseAND(F.lit((1 << BITS) - 1)) > 1
    marked = lambda lane: reduce(Column.bitwiseOR, [F.when(cell(lane, i), 1 << i).otherwise(0) for i in range(CELLS)])
    full = F.lit((1 << CELLS) - 1)
    lanes = [F.when((F.col("n") < 1 << BITS) & F.col(lane).isNotNull(), marked(lane)).otherwise(full) for lane in ("left", "right")]
    masks = blocks.select("block", lanes[0].alias("left"), lanes[1].alias("right")).where("left > 0 AND right > 0")
    return masks.select("block", F.col("left").bitwiseOR(F.shiftleft("right", CELLS)).alias("mask"))


def _marked(located: DataFrame, bits: DataFrame) -> DataFrame:
    """Adds ``maybe``: whether the filter has the row's digest as possibly repeated. No row is shuffled."""
    slices = max(1, -(-bits.count() // max(1, SENT_WORDS)))
    own = F.pmod("block", F.lit(slices)).cast("int")
    located, bits = located.withColumn("slice", own), bits.withColumn("slice", own)
    if slices > 1:  # each task writes a file for each of its slices, so that a slice's join reads that slice alone
        located, bits = written(located, "slices", by="slice"), written(bits, "words", by="slice")
    of = lambda k: located.where(F.col("slice") == k).join(F.broadcast(bits.where(F.col("slice") == k).drop("slice")), "block", "left")
    parts = [of(k) for k in range(slices)]
    maybe = F.expr(f"coalesce(shiftright(mask, cast(left as int)) & shiftright(mask, cast(right as int) + {CELLS}) & 1, 0) = 1")
    return reduce(DataFrame.unionByName, parts).select("id", "text_sha256", maybe.alias("maybe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, kept or not: the group of texts equal but for the case of A-Z.

    Returns ``id_col``, keep_id (largest id of the group), group_size, kept and
    text_sha256 (of the folded text). The first pass hashes every text and
    counts in the filter; the second looks each row up in the marked blocks,
    which are sent to the tasks: rows that aren't marked are unique and pass
    straight through, the rest are grouped by digest, pre-aggregated, and joined
    to their group. Hot groups are sent to their rows instead.

    Null and blank texts are texts like any other (null equals empty). Rows
    that repeat both id and text stay or go together. Null ids are smaller than
    all others. Other columns are ignored. An empty table gives an empty result.
    """
    hashed = written(docs.select(F.col(id_col).alias("id"), F.sha2(folded(F.col(text_col)).cast("binary"), 256).alias("text_sha256")), "hashed")
    rows = hashed.count()
    located = _located(hashed, rows)
    marked = _marked(located, written(repeated_filter(located), "filter"))
    result = lambda df: df.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    alone = marked.where("NOT maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = written(marked.where("maybe").select("id", "text_sha256"), "again")
    groups = written(again.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    hot = F.col("group_size") > max(HOT_ROWS, rows // HOT_GROUPS)
    sent = F.broadcast(groups.where(hot))
    few = again.join(F.broadcast(groups.where(hot).select("text_sha256")), "text_sha256", "left_anti").join(groups.where(~hot), "text_sha256")
    return alone.unionByName(result(again.join(sent, "text_sha256"))).unionByName(result(few)).withColumnRenamed("id", id_col)
