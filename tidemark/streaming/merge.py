"""Merge-on-read tables for streams: a batch writes its changes only, and readers put them together.

Rows lie in buckets by a hash of their key. ``changes`` has a folder for each
batch and bucket, ``base`` one for each generation and bucket, and a version of
``manifest`` says, for each bucket, which generation is its base and from which
batch on changes count. A batch's version is written last, and a batch that is
run again writes the same folders, so nothing counts twice. A bucket is put
together anew when it has as many batches of changes as ``most``; others stay
untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

MANIFEST = "version int, bucket int, gen int, since int, held int"
ORDER = "__batch"


class MergeTable:
    """rules: for each column beside the key one of new, old, min, max, first_new (the last that is not null) and first_old (the first one).

    ``order`` names the column that orders changes of one key within a batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], rules: dict[str, str], order: str, buckets: int = 64, most: int = 8):
        self.spark, self.path, self.schema, self.key, self.rules, self.order, self.buckets, self.most = spark, path, schema, key, rules, order, buckets, most
        empty = spark.createDataFrame([], self._kind())
        empty.write.mode("ignore").parquet(f"{path}/base/gen=-1/bucket=0")
        empty.write.mode("ignore").parquet(f"{path}/changes/batch=-1/bucket=0")
        first = spark.createDataFrame([(-1, b, -1, 0, 0) for b in range(buckets)], MANIFEST)
        first.coalesce(1).write.mode("ignore").parquet(f"{path}/manifest/v-1")

    def _kind(self) -> T.StructType:
        fields = [f for f in self.schema.fields if f.name in (*self.key, *self.rules)]
        return T.StructType([*fields, T.StructField(ORDER, T.IntegerType())])

    def _read(self, name: str, part: str) -> DataFrame:
        kind = T.StructType([*self._kind().fields, T.StructField(part, T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}")

    def manifest(self, version: int | None = None) -> list[Row]:
        """The rows of a version, the last one if none is named; one for each bucket."""
        rows = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")
        version = rows.agg(F.max("version")).first()[0] if version is None else version
        return rows.where(F.col("version") == version).collect()

    def _reduced(self, rows: DataFrame, order: Column) -> DataFrame:
        def value(c: str, rule: str) -> Column:
            x, known = F.col(c), F.col(c).isNotNull()
            return {
                "new": F.max_by(F.struct(x), order)[c], "old": F.min_by(F.struct(x), order)[c], "min": F.min(x), "max": F.max(x),
                "first_new": F.max_by(x, F.when(known, order)), "first_old": F.min_by(x, F.when(known, order)),
            }[rule]

        return rows.groupBy(*self.key).agg(*[value(c, r).alias(c) for c, r in self.rules.items()], F.max(ORDER).alias(ORDER))

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table as of a version; of all buckets or some."""
        return self._whole(self.manifest(version), buckets).drop(ORDER)

    def _whole(self, manifest: list[Row], buckets: list[int] | None = None) -> DataFrame:
        wanted = [m for m in manifest if buckets is None or m.bucket in buckets]
        version = max(m.version for m in manifest)
        either = lambda conditions: reduce(Column.__or__, conditions, F.lit(False))
        # Both conditions are on partition columns only: at most one for each bucket.
        base = self._read("base", "gen").where(either((F.col("gen") == m.gen) & (F.col("bucket") == m.bucket) for m in wanted if m.gen >= 0))
        changes = self._read("changes", "batch").where(either((F.col("batch") >= m.since) & (F.col("batch") <= version) & (F.col("bucket") == m.bucket) for m in wanted if m.held))
        return self._reduced(base.drop("gen", "bucket").unionByName(changes.drop("batch", "bucket")), F.col(ORDER))

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def write(self, changes: DataFrame, batch: int) -> None:
        """The changes of a batch; batches have numbers from 0 on, each one more than the last."""
        changes = changes.withColumn(ORDER, F.lit(batch))
        reduced = self._reduced(changes, F.struct(self.order, *sorted(self.rules))).withColumn("bucket", self.bucket_of())
        folder = f"{self.path}/changes/batch={batch}"
        reduced.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        touched = {r.bucket for r in self.spark.read.parquet(folder).select("bucket").distinct().collect()} if not reduced.isEmpty() else set()
        before = {m.bucket: m for m in self.manifest(batch - 1)}
        now = [(batch, b, m.gen, m.since, m.held + (b in touched)) for b, m in before.items()]
        full = [b for _, b, _, _, held in now if held >= self.most]
        if full:
            merged = self._whole([Row(version=v, bucket=b, gen=g, since=s, held=h) for v, b, g, s, h in now], full)
            merged.withColumn("bucket", self.bucket_of()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/gen={batch}")
            now = [(v, b, batch, batch + 1, 0) if b in full else (v, b, g, s, h) for v, b, g, s, h in now]
        self.spark.createDataFrame(now, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{batch}")


def merge_stream(stream: DataFrame, table: MergeTable, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each micro-batch becomes a batch of the table. Without ``every`` the query takes what is there and stops."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: table.write(batch, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
