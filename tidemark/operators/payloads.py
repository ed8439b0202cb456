"""Semi-structured payloads as VARIANT: equality by value, typed fields, and what changed from one to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(payload: Column) -> Column:
    """JSON text with sorted keys, no blanks and plain decimals, so that equal values have equal texts.

    What is no JSON (an object that names a key twice included) stays as it is.
    Numbers with an exponent are doubles and differ from decimals, ``1e2`` from ``100``.
    """
    return F.coalesce(F.to_json(F.try_parse_json(payload)), payload)


def changed_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose payload differs in value from the one before of the same session and source.

    The first always stays. Payloads come back in canonical form. Snapshots of
    one time are in no order unless ``captured_at`` holds one (a struct can).
    """
    w = Window.partitionBy("session_id", "source").orderBy("captured_at")
    same = F.col("payload").eqNullSafe(F.lag("payload").over(w)) & (F.row_number().over(w) > 1)
    return snapshots.withColumn("payload", canonical(F.col("payload"))).withColumn("__same", same).where(~F.col("__same")).drop("__same")


def payload_fields(rows: DataFrame, fields: dict[str, tuple[str, str]], payload: str = "payload") -> DataFrame:
    """Adds a column for each of ``fields``, name: (path, type). A path that is absent, or a value that is no such type, gives null."""
    parsed = F.try_parse_json(payload)
    return rows.withColumns({name: F.try_variant_get(parsed, path, kind) for name, (path, kind) in fields.items()})


def payload_schema(rows: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """(keys, schema, n, malformed): the type that holds all payloads of a key, merged before the shuffle."""
    parsed = F.try_parse_json(payload)
    bad = F.count_if(F.col(payload).isNotNull() & parsed.isNull())
    return rows.groupBy(*keys).agg(F.schema_of_variant_agg(parsed).alias("schema"), F.count("*").alias("n"), bad.alias("malformed"))


def field_changes(snapshots: DataFrame, keys: list[str], order: list[str], payload: str = "payload", depth: int = 8) -> DataFrame:
    """(keys, order, path, before, after): the values that differ from the snapshot before.

    Objects on both sides are compared field by field, ``depth`` levels deep;
    anything else (arrays, other types, deeper objects) as a whole. A field that
    one side lacks is null there, a JSON null is the text ``null``. The first
    snapshot of a key and one that is or follows no object is one change at
    ``$``. One shuffle by ``keys``; the levels are generators within a task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    names = [*keys, *order]
    root = snapshots.select(*names, canonical(F.col(payload)).alias("__after"), F.lag(canonical(F.col(payload))).over(w).alias("__before"))
    rows = root.where(~F.col("__after").eqNullSafe(F.col("__before"))).withColumn("__path", F.lit("$"))
    fields = lambda side: F.try_variant_get(F.try_parse_json(side), "$", "map<string,variant>")
    for _ in range(depth):
        rows = rows.withColumns({"__a": fields("__before"), "__b": fields("__after")})
        both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
        value = lambda side, key: F.to_json(F.try_element_at(side, key))
        each = F.transform(
            F.array_union(F.map_keys("__a"), F.map_keys("__b")),
            lambda key: F.struct(F.concat("__path", F.lit("."), key).alias("p"), value(F.col("__a"), key).alias("a"), value(F.col("__b"), key).alias("b")),
        )
        whole = F.array(F.struct(F.col("__path").alias("p"), F.col("__before").alias("a"), F.col("__after").alias("b")))
        differing = F.filter(F.when(both, each).otherwise(whole), lambda x: ~x["a"].eqNullSafe(x["b"]))
        rows = rows.select(*names, F.explode(differing).alias("x")).select(*names, F.col("x.p").alias("__path"), F.col("x.a").alias("__before"), F.col("x.b").alias("__after"))
    return rows.select(*names, F.col("__path").alias("path"), F.col("__before").alias("before"), F.col("__after").alias("after"))
