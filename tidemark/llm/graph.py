"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written_with


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, and their number and sum of hashes, by which a round that changes nothing is known."""
    out, seen = written_with(edges, "edges", hashes=F.sum(F.hash("u", "v").cast("long")))
    return out, (seen["rows"], seen["hashes"])


def star_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node it reaches.

    Each step keeps at most as many edges as before and needs about log(n)
    rounds. Minima are pre-aggregated before the shuffle; each round is written
    to the shared folder, so a lost executor costs one round. Null ends and
    self-links only name their node; an empty input gives an empty result.
    """
    named = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    now, mark = _written(named.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while before != mark:
        before = mark
        # Large star: every larger neighbour of u goes to the smallest neighbour of u.
        both = now.union(now.select("v", "u")).where("u <> v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(now.where("u = v")).distinct()
        # Small star: every smaller neighbour of u, and u, go to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now, mark = _written(small.where("u >= v").distinct())
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
