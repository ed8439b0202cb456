"""Segmented scans: lag, running sum and last value by key, where one key may hold most of the rows.

A window over a heavy key is one task. Here rows are range-partitioned by keys
and order, so that a heavy key takes many parts; a scan runs within the parts,
and what a part hands on to the next (the last row, the sum, the last value) is
combined in a table of at most two rows for each part, which every task gets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import written

PART = "__part"


def parted(rows: DataFrame, keys: list[str], order: list[str], count: int | None = None) -> DataFrame:
    """``rows`` in ranges of keys and order, written once, with the number of each row's part.

    ``order`` should leave no ties: tied rows of a key may come in either order.
    Without a ``count`` of parts, the session's number of shuffle partitions counts.
    """
    by = [*keys, *order]
    return written(rows.repartitionByRange(*([count] if count else []), *by).withColumn(PART, F.spark_partition_id()), "parted")


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & a[c].eqNullSafe(b[f"__{c}"])
    return out


def _edges(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the first and the last key of each part; no other key can go on in another part."""
    if not keys:
        return parts
    key = F.struct(*keys)
    ends = parts.groupBy(PART).agg(F.min(key).alias("__low"), F.max(key).alias("__high")).withColumnRenamed(PART, "__of")
    ends = F.broadcast(ends)  # a row for each part
    return parts.join(ends, parts[PART] == ends["__of"]).where(key.eqNullSafe(F.col("__low")) | key.eqNullSafe(F.col("__high"))).drop("__of", "__low", "__high")


def scan(parts: DataFrame, keys: list[str], order: list[str], previous: dict[str, Column] | None = None, running: dict[str, Column] | None = None, latest: dict[str, Column] | None = None, highest: dict[str, Column] | None = None) -> DataFrame:
    """Adds columns to ``parted`` rows.

    ``previous``: the value of the row before within the keys, null at the first;
    ``running``: the sum up to and including the row (of whole numbers; null
    counts as 0); ``latest``: the last value that is not null up to and including
    the row; ``highest``: the greatest so far. Null keys are keys like any other.
    """
    previous, running, latest, highest = previous or {}, running or {}, latest or {}, highest or {}
    w = Window.partitionBy(PART, *keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns(
        {"__first": F.row_number().over(w) == 1}
        | {n: F.lag(c).over(w) for n, c in previous.items()} | {n: F.sum(F.coalesce(c, F.lit(0))).over(upto) for n, c in running.items()}
        | {n: F.last(c, ignorenulls=True).over(upto) for n, c in latest.items()} | {n: F.max(c).over(upto) for n, c in highest.items()}
    )
    place = F.struct(*order)
    ends = _edges(parts, keys).groupBy(PART, *keys).agg(
        F.count("*").alias("__n"), *[F.max_by(c, place).alias(n) for n, c in previous.items()], *[F.sum(F.coalesce(c, F.lit(0))).alias(n) for n, c in running.items()],
        *[F.max_by(c, F.when(c.isNotNull(), place)).alias(n) for n, c in latest.items()], *[F.max(c).alias(n) for n, c in highest.items()],
    )
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        F.col(PART).alias(f"__{PART}"), *[F.col(k).alias(f"__{k}") for k in keys], *[F.last(n).over(before).alias(f"__in_{n}") for n in previous],
        *[F.sum(n).over(before).alias(f"__in_{n}") for n in running], *[F.last(n, ignorenulls=True).over(before).alias(f"__in_{n}") for n in latest],
        *[F.max(n).over(before).alias(f"__in_{n}") for n in highest],
    )
    out = local.join(F.broadcast(carry), _same(local, carry, [PART, *keys]), "left")  # at most two rows for each part
    out = out.withColumns(
        {n: F.when(F.col("__first"), F.col(f"__in_{n}")).otherwise(F.col(n)) for n in previous}
        | {n: F.col(n) + F.coalesce(F.col(f"__in_{n}"), F.lit(0)) for n in running} | {n: F.coalesce(n, f"__in_{n}") for n in latest}
        | {n: F.greatest(n, f"__in_{n}") for n in highest}
    )
    return out.select(*parts.columns, *previous, *running, *latest, *highest)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "place", count: int | None = None) -> DataFrame:
    """``rows`` with their place within the keys, from 0; ``count``: see ``parted``."""
    parts = parted(rows, keys, order, count)
    return scan(parts, keys, order, running={name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1).drop(PART)


def least_of_run(parts: DataFrame, keys: list[str], run: str, value: str, name: str) -> DataFrame:
    """Adds the least value of each run (a number that does not fall along the order) of parted rows."""
    inside = F.min(value).over(Window.partitionBy(PART, *keys, run))
    pieces = _edges(parts, keys).groupBy(PART, *keys, run).agg(F.min(value).alias("__least"))
    across = pieces.groupBy(*[F.col(k).alias(f"__{k}") for k in [*keys, run]]).agg(F.count("*").alias("__parts"), F.min("__least").alias("__least")).where("__parts > 1")
    across = F.broadcast(across)  # at most one run for each end of a part
    local = parts.withColumn(name, inside)
    return local.join(across, _same(local, across, [*keys, run]), "left").withColumn(name, F.coalesce("__least", name)).select(*parts.columns, name)
