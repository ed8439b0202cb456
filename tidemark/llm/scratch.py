"""Tables that cut lineage, in the shared folder named by ``spark.checkpoint.dir``.

A written table survives the loss of any executor, and unlike a checkpoint it
is compressed and column-pruned when read again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512  # rows that a Python worker gets at a time


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A temporary one is set only where none is and all tasks run in this process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Fewer rows to a Python batch than Spark's default of 10,000, as rows hold whole texts.

    Every operator here sees to this for its session; a setting of one's own stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def row_draw(id_col: str, text_col: str) -> Column:
    """A number from 0 to 1 by which rows are drawn, each for itself: those with one id, one text or both too."""
    drawn = F.xxhash64(F.lit("fit"), F.col(id_col), F.col(text_col), F.monotonically_increasing_id())
    return F.pmod(drawn, F.lit(1 << 30)) / F.lit(float(1 << 30))


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a DataFrame over the written rows, in a folder for each value of ``by`` (few values)."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
    df.write.partitionBy(*[by] if by else []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """As ``written``, with the values of some aggregates, observed while writing; ``rows`` is always among them."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in measures.items()]), name)
    return out, seen.get
