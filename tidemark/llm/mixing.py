"""Mixing sources to target weights along a low-discrepancy schedule.

Each slot of the mix belongs to the source whose stretch of the cumulative
weights holds the slot's golden-ratio point. Slots are ranked per source and
joined to the source's blocks of equal numbers of words, which are cut from its
documents in hashed order. A slot without a block left is trimmed; blocks that
the target needs beyond the slots (a few at most) get slots after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import written

BLOCK_WORDS = 256  # words in a block; only a source's last one is shorter
CHUNK = 1 << 16  # slots ranked, or equal documents opened, together
RUN_WORDS = 1 << 20  # words of a source that are laid out together, on average
SENT_SOURCES = 100_000  # sources sent to every task; more are joined by a shuffle
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    """The number of runs of anything but space and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, share: float, weights: list[int], cap: float) -> DataFrame:
    """sizes: source, source_size. Adds each source's rank, weight and target.

    Sources stand in the order of their code points, null last, and take the
    weights in turn. Together they get ``share`` of all words by weight, but
    none more than ``cap`` times its own; what is over goes to the others by
    weight, until none is above. With sources sorted by words per weight, those
    at their cap are a prefix, so one running sum finds the level.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("place", F.row_number().over(order))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("most") / F.col("weight"))
    ranked = ranked.withColumn("at", F.min(F.when(F.col("fits"), F.struct((F.col("most") / F.col("weight")).alias("r"), "place", "level"))).over(whole))
    return ranked.withColumn("target", F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("at.level")))).select("source", "source_size", "place", "target")


def _layout(docs: DataFrame) -> DataFrame:
    """Each document's first word in its source's shuffled stream; ``docs`` have words.

    The shuffle is by a hash of the id, null ids last. Documents equal in id and
    size are laid out as one row, so that a null or repeated id has no more rows
    than it has sizes. Runs of neighbouring hashes are laid out on their own and
    offset by the words before them, so that a source with most of the rows
    takes many tasks.
    """
    runs = F.greatest(F.lit(1).cast("long"), F.floor(F.col("source_size") / RUN_WORDS))
    spread = docs.groupBy("place", "id", "size", "source_size", "target").agg(F.count("*").alias("n"))
    spread = spread.withColumn("hash", F.md5(F.col("id").cast("string"))).withColumn("words", F.col("n") * F.col("size"))
    spread = spread.withColumn("run", F.coalesce(F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * runs / F.lit(float(1 << 32))), runs))
    before = Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    start = spread.groupBy("place", "run").agg(F.sum("words").alias("words")).select("place", "run", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("place", "run").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = spread.join(start, ["place", "run"]).withColumn("first", F.col("start") + F.coalesce(F.sum("words").over(inside), F.lit(0))).drop("run", "start", "hash", "words")
    # Equal documents follow one another; many of them are opened by many tasks.
    laid = laid.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))).repartition("place", "first", "from")
    laid = laid.withColumn("nth", F.explode(F.sequence("from", F.least(F.col("from") + CHUNK, "n") - 1)))
    return laid.withColumn("first", F.col("first") + F.col("nth") * F.col("size")).drop("n", "from", "nth")


def _total(targets: DataFrame) -> float:
    """Of all targets: where the last stretch ends."""
    return targets.select(F.sum("target").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).alias("upper")).agg(F.coalesce(F.max("upper"), F.lit(0.0))).first()[0]


def _slots(targets: DataFrame, block_words: int) -> int:
    return int(_total(targets) // block_words) + 1


def slot_schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(place, rank, slot): the slots of each source, ranked from 0.

    The golden-ratio sequence visits the unit interval evenly; slot i belongs to
    the source whose stretch of the cumulative weights holds frac(i * golden).
    Ranks are counted within chunks of slots and offset by the chunks before.
    """
    spark = targets.sparkSession
    total, slots = _total(targets), _slots(targets, block_words)
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    stretch = targets.where("target > 0").select("place", F.sum("target").over(upto).alias("upper"), (F.sum("target").over(upto) - F.col("target")).alias("lower"))
    # 1,024 cells of the unit interval bring each point to the few stretches that overlap its cell.
    to_cell = lambda c: F.least(F.floor(c / F.lit(total or 1.0) * 1024), F.lit(1023))
    stretch = stretch.withColumn("cell", F.explode(F.sequence(to_cell(F.col("lower")), to_cell(F.col("upper")))))
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN)).alias("x"))
    points = points.select("slot", ((F.col("x") - F.floor("x")) * F.lit(total)).alias("x")).withColumn("cell", to_cell(F.col("x")))
    owned = points.join(F.broadcast(stretch) if targets.count() <= SENT_SOURCES else stretch, "cell").where("x >= lower AND x < upper").select("slot", "place", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    before = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = owned.groupBy("place", "chunk").agg(F.count("*").alias("n")).select("place", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("place", "chunk").orderBy("slot")
    return owned.join(start, ["place", "chunk"]).select("place", (F.row_number().over(inside) - 1 + F.col("start")).alias("rank"), "slot")


def block_schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(place, block, pass, used, slot): which block fills which slot, and how many of its words are used.

    Blocks are cut from the source's shuffled stream of documents, so taking them
    in order keeps documents whole; the last one is cut where the target is
    reached. Slots are the ranks' own ones; a source with fewer slots than its
    target needs blocks is topped up after the last slot.
    """
    slots, sources = _slots(targets, block_words), targets.count()
    per_pass = F.ceil(F.col("source_size") / block_words)
    want = F.round("target").cast("long")
    passes = targets.where("source_size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.floor(want / F.col("source_size")))))
    passes = passes.withColumn("words", F.least(F.col("source_size"), want - F.col("pass") * F.col("source_size"))).where("words > 0")
    passes = passes.withColumn("first", F.col("pass") * per_pass).withColumn("last", F.col("first") + F.ceil(F.col("words") / block_words) - 1)
    has = slot_schedule(targets, block_words)
    most = has.groupBy("place").agg((F.max("rank") + 1).alias("has"))
    needs = passes.groupBy("place").agg(F.max("last").alias("last")).join(most, "place", "left").withColumn("has", F.coalesce("has", F.lit(0)))
    more = needs.where("has <= last").select("place", F.explode(F.sequence("has", "last")).alias("rank"))
    has = has.unionByName(more.withColumn("slot", slots + F.col("rank") * sources + F.col("place")))
    passes = passes.select("place", "pass", "words", F.col("first"), F.col("last"))
    filled = has.join(F.broadcast(passes) if sources <= SENT_SOURCES else passes, "place").where("rank BETWEEN first AND last").withColumn("block", F.col("rank") - F.col("first"))
    return filled.select("place", "block", "pass", F.least(F.lit(block_words).cast("long"), F.col("words") - F.col("block") * block_words).alias("used"), "slot")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), cap: float = 2.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """How often each document is used when sources are mixed to their targets.

    Returns one row per input row: ``id_col``, size (words), source_size, target
    (of its source, in words), taken (words the mix takes of it, repeats counted)
    and first_slot, the first slot of the schedule that it fills, null where none
    is taken. The mix in its order is the documents in the order of slots. A
    source's taken words are its target to the nearest word. A document is
    taken as often as its source's stream passes it, ``cap`` times at most.

    Null texts have size 0 and are taken 0 times; a null source is a source of
    its own, the last one. Ids of null or repeated rows count as ids like any
    other; rows equal in id and size share their place in an arbitrary order.
    The result depends on the rows only, not on their order or partitions. An
    empty table gives an empty result; other columns are ignored.
    """
    sized = written(docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source")), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, share, list(weights), cap), "targets")
    small = targets.count() <= SENT_SOURCES
    named = sized.join(F.broadcast(targets) if small else targets, sized.source.eqNullSafe(targets.source)).drop("source")
    laid = written(_layout(named.where("size > 0")), "laid")
    bounds = F.floor(F.col("first") / block_words), F.floor((F.col("first") + F.col("size") - 1) / block_words)
    pieces = laid.select("place", "first", "size", F.explode(F.sequence(*bounds)).alias("block"))
    start = F.greatest(F.col("first") - F.col("block") * block_words, F.lit(0))
    end = F.least(F.col("first") + F.col("size") - F.col("block") * block_words, F.lit(block_words).cast("long"))
    pieces = pieces.select("place", "first", "block", start.alias("from"), end.alias("to"))
    got = pieces.join(block_schedule(targets, block_words), ["place", "block"])
    got = got.groupBy("place", "first").agg(F.sum(F.greatest(F.lit(0).cast("long"), F.least("to", "used") - F.col("from"))).alias("taken"), F.min(F.when(F.least("to", "used") > F.col("from"), F.col("slot"))).alias("first_slot"))
    out = laid.join(got, ["place", "first"], "left")  # no two documents with words start at the same word
    columns = [F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot"]
    none = named.where("size = 0").select(F.col("id").alias(id_col), "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return out.select(*columns).unionByName(none)
