"""Fuzzy matching with one-to-one assignment: a similarity join of distinct texts, then offers key by key or, of large keys, in rounds."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.fold import grouped
from tidemark.tables import written

HELD = 200_000  # candidates of a key that a task holds


def _pairs_of_letters(text: Column) -> Column:
    """Each two neighbouring characters."""
    return F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _least_common(total: Column, threshold: float) -> Column:
    """Neighbouring pairs that two texts of that length together, or more, must share.

    With M characters matched in blocks, each unmatched one of the first text
    breaks two of its pairs at most and each of the second one: 3 M - total - 1
    stay, and M is at least half the threshold of the total.
    """
    return F.ceil(total * (1.5 * threshold - 1) - 1 - 1e-9)


@F.pandas_udf(T.DoubleType())
def _ratio(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])


def similar_texts(a: DataFrame, b: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by, a, b, ratio) of all texts ``a`` and ``b`` of a key whose matched-blocks ratio reaches the threshold (over 0.7).

    Equal texts join by themselves. Others share so many of their neighbouring
    pairs of characters that the rarest of both must meet: only these prefixes
    are joined, then lengths and whole ratios decide. Of texts so short that none
    must be shared (none at 0.85) those with a common character meet. Texts are
    distinct within a key.
    """
    a, b = (x.select(*by, F.col(c).alias(c)).where(F.col(c).isNotNull() & (F.col(c) != "")).distinct() for x, c in ((a, "a"), (b, "b")))
    a, b = written(a, "texts"), written(b, "texts")
    keys = written(_prefixes(a.select(F.col("a").alias("text")).union(b.select("b")).distinct(), threshold), "prefixes")
    each = lambda rows, c: rows.join(keys.withColumnRenamed("text", c), c).select(*by, c, F.explode("keys").alias("key"), F.col("keys").alias(f"of_{c}"))
    la, lb = F.length("a"), F.length("b")
    tiny = max((n for n in range(2, 1000) if 3 * math.ceil(n * threshold / 2 - 1e-9) - n - 1 <= 0), default=0)
    fits = (F.col("a") != F.col("b")) & (2 * F.least(la, lb) >= threshold * (la + lb))
    # A pair counts where the first key that both prefixes have meets, so it comes once.
    met = each(a, "a").join(each(b, "b"), [*by, "key"]).where(fits & (la + lb > tiny)).where(F.col("key") == F.get(F.array_intersect("of_a", "of_b"), F.lit(0))).select(*by, "a", "b")
    letters = lambda rows, c: rows.where(F.length(c) < tiny).select(*by, c, F.explode(F.array_distinct(F.split(c, ""))).alias("letter"))
    short = letters(a, "a").join(letters(b, "b"), [*by, "letter"]).where(fits & (la + lb <= tiny)).select(*by, "a", "b").distinct()
    met = written(met.unionByName(short), "met")
    # Texts recur from key to key: each two are compared once. A filter before the write would be asked before ``distinct``.
    ratios = written(met.select("a", "b").distinct().withColumn("ratio", _ratio("a", "b")), "ratios")
    near = met.join(ratios.where(F.col("ratio") >= threshold), ["a", "b"]).select(*by, "a", "b", "ratio")
    same = a.join(b.withColumn("a", F.col("b")), [*by, "a"]).select(*by, "a", "b", F.lit(1.0).alias("ratio"))
    return same.unionByName(near)


def _prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """(text, keys): hashes of the rarest pairs of letters of each text, of which it must share one with any like text, the rarest first."""
    each = texts.select("text", F.posexplode(_pairs_of_letters(F.col("text"))).alias("at", "two"))
    nth = F.row_number().over(Window.partitionBy("text", "two").orderBy("at"))
    grams = each.select("text", F.xxhash64("two", nth).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    n = F.length("text")
    other = F.ceil(n * (threshold / (2 - threshold)) - 1e-9)  # the shortest text that can be like this one
    size = n - 1 - F.greatest(F.lit(1), _least_common(n + other, threshold)) + 1
    whole = grams.join(often, "gram").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("x"))
    return whole.select("text", F.array_distinct(F.slice(F.col("x.gram"), F.lit(1), F.greatest(F.lit(0), size).cast("int"))).alias("keys"))


def assign_once(asking: DataFrame, offers: DataFrame, ranked: DataFrame, by: list[str]) -> DataFrame:
    """(by, position, hash, t, ratio): in the order of positions, each takes its best offer that is still free.

    asking: by, position, a; offers: by, hash, t, b; ranked: by, a, b, ratio.
    Better is the higher ratio, then the older, then the smaller hash. Keys with
    up to HELD candidates go one after another through a stream; of larger ones
    no task holds the candidates, they are worked out in rounds.
    """
    best = Window.partitionBy(*by, "a").orderBy(F.col("ratio").desc(), "t", "hash")
    lists = written(ranked.join(offers, [*by, "b"]).select(*by, "a", "hash", "t", "ratio").withColumn("place", F.row_number().over(best)), "lists")
    sizes = written(lists.groupBy(*by).agg((F.count("*") > HELD).alias("large")), "sizes")
    of = lambda rows, large: rows.join(sizes.where(F.col("large") == large).drop("large"), by)
    found = _in_turn(of(asking, False), of(lists, False), by)
    return found if sizes.where("large").isEmpty() else found.unionByName(_in_rounds(of(asking, True), written(of(lists, True), "large"), by))


def _in_turn(asking: DataFrame, lists: DataFrame, by: list[str]) -> DataFrame:
    """``assign_once`` by its own rule, a key at a time."""
    names = ["a", "hash", "t", "ratio", "position"]
    kind = lambda c: asking.schema[c].dataType if c == "position" else lists.schema[c].dataType
    null = lambda c: F.lit(None).cast(kind(c)).alias(c)
    rows = lists.select(*by, "place", *names[:4], null("position")).unionByName(asking.select(*by, F.lit(0).alias("place"), "a", *map(null, names[1:4]), "position"))

    def run(held: list[tuple]) -> Iterator[tuple]:
        offers: dict[str, list[tuple]] = {}
        next_of, used = {}, set()
        for a, *offer, position in held:
            if position is None:
                offers.setdefault(a, []).append(offer)
        for a, *_, position in held:
            if position is None or a not in offers:
                continue
            at, options = next_of.get(a, 0), offers[a]
            while at < len(options) and options[at][0] in used:
                at += 1
            next_of[a] = at  # what was used stays used
            if at < len(options):
                used.add(options[at][0])
                yield position, *options[at]

    return grouped(rows, by, ["place", "position"], names, run, ", ".join(f"{c} {kind(c).simpleString()}" for c in ("position", "hash", "t", "ratio")))


def _in_rounds(asking: DataFrame, lists: DataFrame, by: list[str]) -> DataFrame:
    """``assign_once`` in rounds.

    All who have nothing ask for their next best at once, and each offer keeps
    the first position among those who asked and who holds it; the others go on
    to what no earlier position holds. As every offer prefers earlier positions,
    that ends where the sequential rule does. Of several with one text the n-th
    begins with the n-th best, since those before take as many.
    """
    nth = F.row_number().over(Window.partitionBy(*by, "a").orderBy("position"))
    active = written(asking.select(*by, "position", "a", nth.alias("place")), "active")
    held = active.sparkSession.createDataFrame([], lists.select(*by, "hash").schema.add("position", asking.schema["position"].dataType).add("a", T.StringType()).add("place", T.IntegerType()))
    names = [*by, "hash", "position", "a", "place"]
    while True:
        asked = active.join(lists, [*by, "a", "place"]).select(*names)
        every = held.select(*names).unionByName(asked)
        keeps = every.groupBy(*by, "hash").agg(F.min_by(F.struct("position", "a", "place"), "position").alias("x"))
        now = written(keeps.select(*by, "hash", "x.position", "x.a", "x.place"), "held")
        sent = every.join(now.select(*by, "hash", F.col("position").alias("first")), [*by, "hash"]).where(F.col("position") > F.col("first"))
        # From the next place on, to what nobody or a later position holds.
        rest = sent.select(*by, "position", "a", F.col("place").alias("was")).join(lists.select(*by, "a", "hash", "place"), [*by, "a"]).where("place > was")
        free = rest.join(now.select(*by, "hash", F.col("position").alias("holder")), [*by, "hash"], "left").where("holder IS NULL OR holder > position")
        active = written(free.groupBy(*by, "position", "a").agg(F.min("place").alias("place")), "active")
        held = now
        if active.isEmpty():
            break
    return held.join(lists, [*by, "a", "hash", "place"]).select(*by, "position", "hash", "t", "ratio")
