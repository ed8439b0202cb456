"""Near-duplicate lines by a segment-partition edit join.

A line within t edits of another keeps at least one of the other's t + 1
segments whole, moved by few characters. So the shorter line is indexed by the
hashes of its segments, and the longer one probes with those of its substrings
that a segment can have moved to, given both lengths. Only keys that different
lines share go on; their lines are compared by Spark's bounded ``levenshtein``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import star_components
from tidemark.llm.scratch import written

EDITS = 2  # at most
CHARS_PER_EDIT = 20  # a line has an edit for each so many characters, up to EDITS
BLANK = " \t\r\x0b\x0c"  # trimmed from both ends of a line
BLOCK = 64  # lines that a probing line is compared with in one row
SENT_IDS = 1_000_000  # candidate lines whose ids are sent to every task; more are joined by a shuffle


def allowed_edits(length: Column) -> Column:
    return F.least(F.lit(EDITS), F.floor(length / CHARS_PER_EDIT).cast("int"))


def _probes() -> list[tuple[int, int, int, int]]:
    """(edits, shorter, i, move): for a line to be met that is ``shorter`` characters shorter and allows ``edits``, where its segment i can be.

    Edits before the segment move it by at most i, those after it leave edits - i.
    """
    return [
        (edits, shorter, i, move)
        for edits in range(1, EDITS + 1)
        for shorter in range(edits + 1)
        for i in range(edits + 1)
        for move in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1)
    ]


def segment_keys(lines: DataFrame) -> DataFrame:
    """(id, key, own) from (line, n): own keys stand in the index and probe equal lengths, the others only probe.

    Segments are nearly equal, the longer ones last. The probes are rows of a
    constant array, so that one short expression does for all of them.
    """
    names = ("edits", "shorter", "i", "move")
    each = F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, p)]) for p in _probes()]))
    rows = lines.select("line", "n", F.xxhash64("line").alias("id")).select("*", each).withColumn("size", F.col("n") - F.col("shorter")).where(allowed_edits(F.col("size")) == F.col("edits"))
    parts = F.col("edits") + 1
    short = parts - F.pmod("size", parts)
    base = F.floor(F.col("size") / parts).cast("int")
    rows = rows.withColumn("start", base * F.col("i") + F.greatest(F.lit(0), F.col("i") - short) + 1 + F.col("move")).withColumn("width", base + (F.col("i") >= short).cast("int"))
    rows = rows.where((F.col("start") >= 1) & (F.col("start") + F.col("width") - 1 <= F.col("n")))
    key = F.xxhash64("size", F.col("edits") * 10 + F.col("i"), F.substring("line", F.col("start"), F.col("width")))
    return rows.select("id", key.alias("key"), ((F.col("shorter") == 0) & (F.col("move") == 0)).alias("own"))


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line_no, line): trimmed lines that are not empty, numbered from 0."""
    exploded = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return exploded.select("doc", "line_no", F.btrim("line", F.lit(BLANK)).alias("line")).where("line <> ''")


def within_edits(line: Column, other: Column, most: Column, edits: int) -> Column:
    """Whether ``other``, which is no longer, is within ``most`` edits (``edits`` at most) of ``line``.

    Beyond ``edits``, levenshtein is -1, which the modulus makes edits + 1.
    """
    return F.pmod(F.levenshtein(line, other, edits), F.lit(edits + 2)) <= most


def _links(rows: DataFrame) -> DataFrame:
    """(a, b): digests of different lines (line) within the allowed edits, enough of them to connect each class.

    Each line is first compared with the most frequent indexed line of each of
    its keys. A family of near lines becomes one class by that, and only lines of
    different classes go on to be compared with all lines of their keys.
    """
    lines = rows.select("line", F.char_length("line").alias("n")).where(F.col("n") >= CHARS_PER_EDIT)
    # Both sides of the join below come from this one shuffle, so they must have the same columns.
    keys = segment_keys(lines).repartition("key")
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("own").alias("indexed")).where("lo < hi AND indexed").select("key")
    chosen = written(keys.join(shared, "key").groupBy("key", "id").agg(F.max("own").alias("own")), "keys")
    ids = written(chosen.select("id").distinct(), "ids")
    ids = ids if ids.count() > SENT_IDS else F.broadcast(ids)
    texts = written(lines.withColumn("id", F.xxhash64("line")).join(ids, "id", "left_semi").groupBy("id", "line", "n").agg(F.count("*").alias("times")), "lines")

    def close(line: Column, other: Column) -> Column:
        gap, most = F.char_length(line) - F.char_length(other), allowed_edits(F.char_length(other))
        return (gap >= 0) & (gap <= most) & (line != other) & within_edits(line, other, most, EDITS)

    heads = chosen.where("own").join(texts.select("id", "times"), "id").groupBy("key").agg(F.max(F.struct("times", "id")).getField("id").alias("head"))
    pairs = chosen.join(heads, "key").where("id <> head").select("id", "head").distinct()
    near = pairs.join(texts.select("id", "line"), "id").join(texts.select(F.col("id").alias("head"), F.col("line").alias("other")), "head")
    first = written(near.where(close(F.col("line"), F.col("other"))).select("id", "head", "line", "other"), "near")
    labels = star_components(first, "id", "head").select(F.col("node").alias("id"), F.col("root").alias("label"))
    placed = written(chosen.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "placed")
    several = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count_if("own") / BLOCK).alias("blocks")).where("lo < hi").select("key", "blocks")
    index = placed.where("own").join(several, "key").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), "blocks")).join(texts, "id")
    index = index.groupBy("key", "block").agg(F.collect_list(F.struct("line", "label")).alias("others"))
    probes = placed.join(several.select("key"), "key").select("key", "id", "label").join(texts, "id").select("key", "line", "label")
    found = probes.join(index, "key").select("line", F.explode(F.filter("others", lambda x: (x["label"] != F.col("label")) & close(F.col("line"), x["line"]))["line"]).alias("other"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return first.select("line", "other").unionByName(found).select(digest("line").alias("a"), digest("other").alias("b")).distinct()


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that is not blank: ``id_col``, line_no, class_id, class_size and kept.

    Two lines, without the white space around them, are linked when they are
    equal or differ by one edit per CHARS_PER_EDIT characters of the shorter, up
    to EDITS; classes are what links connect. class_id is the digest of one of
    its lines, class_size its number of lines in all documents, and kept marks
    the first by id and line number (null ids last). Null and blank texts have
    no lines; repeated rows with an id have equal places, and both firsts stay.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = written(split_lines(docs, id_col, text_col), "occurrences")
    links = written(_links(rows), "links")
    lines = rows.select("doc", "line_no", F.sha2(F.col("line").cast("binary"), 256).alias("digest"))
    roots = star_components(links, "a", "b").select(F.col("node").alias("digest"), F.col("root").alias("class_id"))
    place = F.struct(F.col("doc").isNull().alias("last"), F.col("doc").alias("doc"), F.col("line_no").alias("line_no"))
    per_line = lines.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    named = per_line.join(roots, "digest", "left").withColumn("class_id", F.coalesce("class_id", "digest"))
    classes = named.groupBy("class_id").agg(F.sum("n").alias("class_size"), F.min("first").alias("first")).where("class_size > 1")
    again = named.join(classes.select("class_id", "class_size", F.col("first").alias("whole")), "class_id").select("digest", "class_id", "class_size", "whole")
    out = lines.join(again, "digest", "left")
    return out.select(
        F.col("doc").alias(id_col), "line_no", F.coalesce("class_id", "digest").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (F.col("whole").isNull() | F.col("doc").eqNullSafe(F.col("whole.doc")) & (F.col("line_no") == F.col("whole.line_no"))).alias("kept"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with every line dropped that is not the first of its class; blank lines stay.

    Rows that share an id share the lines dropped from it, so ids should be unique here.
    """
    classes = line_classes(docs, id_col, text_col).where("NOT kept")
    dropped = classes.groupBy(F.col(id_col).alias("doc")).agg(F.collect_set("line_no").alias("lines")).select("doc", "lines")
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # no name can clash
    joined = packed.join(dropped, F.col("id").eqNullSafe(F.col("doc")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("lines", i)), "\n")
    new = F.when(F.col("lines").isNull(), F.col("text")).otherwise(left)
    return joined.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
