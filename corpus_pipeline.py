"""The training-data pipeline: documents through one operator after another.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir).
``run`` writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.langid import UNKNOWN, identify_languages, train_language_model
from tidemark.llm.mixing import mix_sources
from tidemark.llm.scratch import written
from tidemark.llm.sharding import shard

SHARDS = 40
LEAST_SHARE = 0.5  # of a document's words in its main language
SENT_IDS = 1_000_000  # ids sent to every task; more are joined by a shuffle


def _sent(ids: DataFrame) -> DataFrame:
    return ids if ids.count() > SENT_IDS else F.broadcast(ids)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose key is in ``ids``."""
    ids = _sent(written(ids.select(F.col("key").alias("gone")).distinct(), "gone"))
    return docs.join(ids, docs["key"] == ids["gone"], "left_anti")


def _keyed(docs: DataFrame) -> DataFrame:
    """``key``, binary, which no two rows share and which is never null; text and source; and ``row``, the whole row.

    As all given columns are in ``row``, their names clash with none of the stages'.
    Keys are ordered by doc_id, null last, then by a hash of all columns. So they
    come out alike whenever they are computed; only rows that are equal in all
    columns are written to the shared folder, with numbers of their own.
    """
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # in the order of signed numbers
    by_id = F.coalesce(F.concat(F.lit("00"), number), F.lit("01" + "0" * 16))
    hashed = F.md5(F.concat(*[F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in docs.columns]))
    keyed = docs.select(F.unhex(F.concat(by_id, hashed)).alias("key"), "text", "source", F.struct(*docs.columns).alias("row"))
    equal = written(keyed.groupBy("key").count().where("count > 1").select(F.col("key").alias("equal")), "equal")
    if equal.isEmpty():
        return keyed
    equal = _sent(equal)
    same = keyed.join(equal, keyed["key"] == equal["equal"], "left_semi").withColumn("nth", F.monotonically_increasing_id())
    same = written(same, "same").withColumn("key", F.concat("key", F.unhex(F.lpad(F.hex("nth"), 16, "0")))).drop("nth")
    return keyed.join(equal, keyed["key"] == equal["equal"], "left_anti").unionByName(same)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows without letters, and those whose main language has less than half their words.

    Each row is judged by its own text, whatever other rows have its id; null and
    empty texts have no letter and go.
    """
    keyed = _keyed(docs)
    found = identify_languages(keyed, train_language_model(docs), id_col="key")
    return _without(keyed, found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < LEAST_SHARE))).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class at five words and similarity 0.8: that with the smallest id.

    A null id counts as larger than any other; among rows of one id a hash of the
    row decides. Rows of one id with other texts are in classes of their own.
    Null, empty and blank texts are like nothing and all stay.
    """
    keyed = _keyed(docs)
    return _without(keyed, jaccard_components(keyed, id_col="key", width=5, percent=80).where("key <> component_id")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows in whose own text a benchmark item is found.

    Each row is judged by its own text, whatever its id; null and empty texts stay.
    """
    keyed = _keyed(docs)
    return _without(keyed, find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each row as often as the mix takes it, to the nearest whole time; rows of one id have times of their own.

    Texts without words are taken 0 times and go. The schedule's slots say when a
    row's words come; a table has no order, so they are not in the columns.
    """
    keyed = _keyed(docs)
    mix = mix_sources(keyed, id_col="key").select(F.col("key").alias("mixed"), F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int").alias("times"))
    mix = _sent(written(mix.where("times > 0"), "mix"))
    joined = keyed.join(mix, keyed["key"] == mix["mixed"])
    return joined.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every row of the mix its shard and slot; null ids, repeated rows and null or empty texts are records like any other."""
    return shard(docs, SHARDS, keep=("lang", "source", "n_chars"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None  # language identification and retrieval are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
