"""Tables that cut lineage, in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A temporary one is set only where none is and all tasks run in this process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Fewer rows to a Python batch than Spark's default of 10,000, for wide rows; a setting of one's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame over the written rows, which survive the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
