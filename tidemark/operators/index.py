"""A stored inverted index: postings in blocks, read by term, with bounds for the best results.

Folders under ``path``: ``docs`` (one row for each indexed text, with its number),
``postings`` (a row for each term and range of document numbers, sorted by term),
``files`` (least and greatest term of each postings file), ``tombstones`` and
``batches``. A batch counts once its row is in ``batches``, so one that was
broken off is written anew by the next ``add``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scan import numbered
from tidemark.operators.search import K1, B, exactness_tier, prefix_match, tokens
from tidemark.tables import small_batches, written

RANGE = 4096  # document numbers in a block
TASK_BYTES = 32 << 20  # of text that a task sorts or takes postings of, on average
RUN_TOKENS = 1_000_000  # that a task counts at a time, and what a few documents have beyond
RUN_DOCS = 32  # documents looked at together
LAST = chr(0x10FFFF)
BATCHES = "batch int, first long, docs long, tokens long, gone_docs long, gone_tokens long"
DOCS = "doc long, range long, type string, ref string, n int, text string, batch int"
POSTINGS = "term string, range long, docs int, tf_max int, len_min int, offsets array<smallint>, tfs array<int>, lens array<int>, batch int"
FILES = "file string, low string, high string, batch int"
TOMBSTONES = "type string, ref string, batch int"


class StoredIndex:
    """Texts with a type and a reference, as ``index_rows`` makes them."""

    def __init__(self, spark: SparkSession, path: str, create: bool = False):
        self.spark, self.path = spark, path
        if create:
            for name, kind in (("batches", BATCHES), ("docs", DOCS), ("files", FILES), ("tombstones", TOMBSTONES)):
                spark.createDataFrame([], kind).write.parquet(f"{path}/{name}")

    def _read(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")

    def batches(self) -> list[Row]:
        """A row for each batch since the last ``compact``."""
        return self._read("batches", BATCHES).orderBy("batch").collect()

    def add(self, rows: DataFrame, replace: bool = False) -> None:
        """Index type, ref and text of each row; with ``replace`` they take the place of all earlier rows of their (type, ref).

        Null texts have no terms; repeated rows are documents of their own.
        """
        done = self.batches()
        batch = max((b.batch for b in done), default=-1) + 1
        first = max((-(-(b.first + b.docs) // RANGE) * RANGE for b in done), default=0)
        self._write(rows, batch, first, [b.batch for b in done], replace)

    def _write(self, rows: DataFrame, batch: int, first: int, done: list[int], replace: bool) -> None:
        at = lambda name: f"{self.path}/{name}/b{batch}"
        parts = _parts(rows)
        placed = numbered(rows.select("type", "ref", "text"), [], ["type", "ref", "text"], "place", parts).withColumn("doc", F.col("place") + first)
        placed = placed.select("doc", F.floor(F.col("doc") / RANGE).alias("range"), "type", "ref", F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)).alias("n"), "text", F.lit(batch).alias("batch"))
        placed.write.mode("overwrite").parquet(at("docs"))
        docs = self.spark.read.schema(DOCS).parquet(at("docs"))
        runs = written(_runs(docs.select("doc", "range", (F.col("doc") - F.col("range") * RANGE).cast("smallint").alias("offset"), "n", tokens(F.col("text")).alias("words"))), "runs")
        # Dealt by range at once, so that the blocks are not shuffled again for the files.
        blocks = _merged(runs.repartitionByRange(parts, "term", "range").sortWithinPartitions("term", "range")).withColumn("batch", F.lit(batch))
        blocks.write.mode("overwrite").parquet(at("postings"))
        terms = self.spark.read.schema(POSTINGS).parquet(at("postings")).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("term").alias("low"), F.max("term").alias("high"))
        terms.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("overwrite").parquet(at("files"))
        gone = (0, 0)
        if replace:
            fresh = docs.select("type", "ref", "batch").distinct()
            old = self.docs(done).join(fresh.drop("batch"), ["type", "ref"], "left_semi")
            gone = old.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            fresh.write.mode("overwrite").parquet(at("tombstones"))
        count, total = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.spark.createDataFrame([(batch, first, count, total, *gone)], BATCHES).write.mode("append").parquet(f"{self.path}/batches")

    def docs(self, batches: list[int] | None = None) -> DataFrame:
        """The documents that no later batch has replaced."""
        known = [b.batch for b in self.batches()] if batches is None else batches
        docs = self._read("docs", DOCS).where(F.col("batch").isin(known))
        dead = self._read("tombstones", TOMBSTONES).where(F.col("batch").isin(known))
        if dead.isEmpty():
            return docs
        dead = dead.groupBy("type", "ref").agg(F.max("batch").alias("__since"))
        replaced = docs["type"].eqNullSafe(dead["type"]) & docs["ref"].eqNullSafe(dead["ref"]) & (docs["batch"] < dead["__since"])
        return docs.join(dead, replaced, "left_anti")

    def compact(self, path: str) -> StoredIndex:
        """A new index at ``path`` with the live documents in one batch."""
        out = StoredIndex(self.spark, path, create=True)
        out.add(self.docs())
        return out

    def is_current(self, commands: DataFrame) -> bool:
        """Whether the index has each session's commands as often as the base."""
        docs = self.docs().where("type = 'command'")
        base = commands.where("session_id IS NOT NULL").groupBy(F.col("session_id").cast("string").alias("ref")).agg(F.count("*").alias("n"))
        have = docs.groupBy("ref").agg(F.count("*").alias("m"))
        return base.join(have, "ref", "full_outer").where(~F.col("n").eqNullSafe(F.col("m"))).isEmpty()

    def postings(self, ranges: list[tuple[str, str]]) -> DataFrame:
        """Blocks of the terms from low to high, both included; only files that can hold them are opened."""
        known = [b.batch for b in self.batches()]
        overlap = reduce(Column.__or__, [(F.col("low") <= high) & (F.col("high") >= low) for low, high in ranges], F.lit(False))
        files = [r.file for r in self._read("files", FILES).where(F.col("batch").isin(known) & overlap).select("file").collect()]
        if not files:
            return self.spark.createDataFrame([], POSTINGS)
        wanted = reduce(Column.__or__, [(F.col("term") >= low) & (F.col("term") <= high) for low, high in ranges])
        return self.spark.read.schema(POSTINGS).parquet(*files).where(wanted)

    def matching(self, query: str, every: bool = True) -> DataFrame:
        """Live documents with all (or any) of the query's words, each a phrase whose last token is a prefix: doc, type, ref, n."""
        words = [w for w in (re.findall(r"\w+", x.lower()) for x in query.split()) if w]
        keys = [(k, t, t + LAST if n + 1 == len(w) else t) for k, w in enumerate(words) for n, t in enumerate(w)]
        if not keys:
            return self.docs().limit(0).select("doc", "type", "ref", "n")
        fits = F.filter(F.array(*[F.when((F.col("term") >= low) & (F.col("term") <= high), i) for i, (_, low, high) in enumerate(keys)]), lambda x: x.isNotNull())
        blocks = self.postings([(low, high) for _, low, high in keys]).select("range", "offsets", F.explode(fits).alias("key"))

        def whole(found: Column) -> Column:
            each = [reduce(Column.__and__, [F.array_contains(found, i) for i, key in enumerate(keys) if key[0] == k]) for k in range(len(words))]
            return reduce(Column.__and__ if every else Column.__or__, each)

        ranges = blocks.groupBy("range").agg(F.collect_set("key").alias("found")).where(whole(F.col("found"))).select("range")
        entries = blocks.join(ranges, "range", "left_semi").select("range", "key", F.explode("offsets").alias("offset")).select((F.col("range") * RANGE + F.col("offset")).alias("doc"), "key")
        hits = entries.groupBy("doc").agg(F.collect_set("key").alias("found")).where(whole(F.col("found"))).select("doc")
        out = self.docs().join(hits, "doc", "left_semi")
        if len(keys) > len(words):  # phrases are read in the texts that have all their tokens
            out = out.where(prefix_match(F.col("text"), query, every))
        return out.select("doc", "type", "ref", "n")

    def counts(self, terms: list[str], live: DataFrame) -> DataFrame:
        """(doc, term, tf) of exact terms in ``live`` documents."""
        blocks = self.postings([(t, t) for t in sorted(set(terms))])
        return _entries(blocks).join(live.select("doc"), "doc", "left_semi")

    def top(self, terms: list[str], k: int = 10, first: int = 8) -> DataFrame:
        """The ``k`` best documents by BM25 over all live ones: doc, type, ref, score; of scores that agree to nine digits the first document.

        A block's bound takes its highest count and its shortest document. The
        ``first`` ranges with the highest sums of bounds are scored, and then
        those whose bound is no less than the k-th score so far; no other
        range can hold a better document, and only their postings are decoded.
        """
        terms = [t.lower() for t in terms]
        blocks = self.postings([(t, t) for t in sorted(set(terms))])
        batches = self.batches()
        docs = sum(b.docs - b.gone_docs for b in batches)
        mean = sum(b.tokens - b.gone_tokens for b in batches) / (docs + 1e-9)
        replaced = any(b.gone_docs for b in batches)
        live = self.docs().select("doc") if replaced else None  # else all documents of the blocks are live
        counted = _entries(blocks).join(live, "doc", "left_semi").groupBy("term").agg(F.count("*").alias("df")) if replaced else blocks.groupBy("term").agg(F.sum("docs").alias("df"))
        frequency = {r.term: r.df for r in counted.collect()}  # a row for each term of the query

        def part(tf: Column, n: Column) -> Column:
            weight = F.lit(0.0)
            for t, df in frequency.items():
                idf = F.log((F.lit(docs) - df + 0.5) / (F.lit(df) + 0.5) + 1 + 1e-9)
                weight = F.when(F.col("term") == t, idf * terms.count(t)).otherwise(weight)
            return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / F.lit(mean)))

        def scored(chosen: DataFrame) -> DataFrame:
            entries = _entries(blocks.join(chosen.select("range"), "range", "left_semi"))
            entries = entries.join(live, "doc", "left_semi") if replaced else entries
            return entries.groupBy("doc").agg(F.sum(part(F.col("tf"), F.col("n"))).alias("score"))

        bounds = blocks.groupBy("range").agg(F.sum(part(F.col("tf_max"), F.col("len_min"))).alias("bound"))
        sure = scored(bounds.orderBy(F.col("bound").desc()).limit(first)).orderBy(F.col("score").desc()).limit(k).collect()
        least = sure[-1].score - 1e-6 if len(sure) == k else 0.0
        best = scored(bounds.where(F.col("bound") >= least)).orderBy(F.round("score", 9).desc(), "doc").limit(k)
        return best.join(self._read("docs", DOCS).select("doc", "type", "ref"), "doc")


def _parts(rows: DataFrame) -> int:
    """Tasks for the texts: the session's shuffle partitions or, of more text, as many as keep a task's share the same."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def _counted(words: Column) -> Column:
    """(term, tf) of each different word: runs of the sorted words, so that a text's words are counted where it is, without a shuffle."""
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  (worked out once, not for each word)

    def runs(w: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        ends = lambda b, k: F.coalesce(F.get(b, k + 1), F.size(w))
        return bound(begins, lambda b: F.transform(b, lambda at, k: F.struct(F.get(w, at).alias("term"), (ends(b, k) - at).cast("int").alias("tf"))))

    return bound(F.array_sort(words), lambda w: F.when(F.size(w) > 0, runs(w)))


def _runs(docs: DataFrame, most: int = RUN_TOKENS) -> DataFrame:
    """(term, range, offsets, tfs, lens) from (doc, range, offset, n, words): pieces of blocks, counted where the texts are.

    A task counts about ``most`` tokens at a time, so a block comes in few pieces
    and what is shuffled are blocks, not a row for each word of a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, RUN_DOCS):
                part = batch.slice(at, RUN_DOCS)
                held.append(part)
                count += len(part.column("words").flatten())
                if count >= most:
                    yield _pieces(held)
                    held, count = [], 0
        if count:
            yield _pieces(held)

    small_batches(docs.sparkSession)
    return docs.select("doc", "range", "offset", "n", "words").mapInArrow(run, "term string, range long, offsets array<smallint>, tfs array<int>, lens array<int>")


def _pieces(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).sort_by("doc").combine_chunks()
    area, offset, n = (table[c].to_numpy() for c in ("range", "offset", "n"))
    words = pa.concat_arrays(table["words"].chunks)
    coded = words.flatten().dictionary_encode()
    at = np.repeat(np.arange(len(n)), words.value_lengths().fill_null(0).to_numpy())
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(n) + at, return_counts=True)
    code, at = pair // len(n), pair % len(n)
    first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(area[at], prepend=-1) != 0))
    cuts = pa.array(np.append(first, len(pair)), pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (offset[at], tf.astype(np.int32), n[at].astype(np.int32))]
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), pa.array(area[at[first]]), *lists], names=["term", "range", "offsets", "tfs", "lens"])


def _merged(runs: DataFrame) -> DataFrame:
    """Blocks (as POSTINGS, without batch) of pieces that are sorted by term and range; at most RANGE entries each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last block of a batch may go on in the next
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            term, area = table["term"].combine_chunks().dictionary_encode().indices.to_numpy(), table["range"].to_numpy()
            first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(area, prepend=-1) != 0))
            if len(first) > 1:
                yield _whole(table.slice(0, first[-1]), first[:-1])
            held = table.slice(first[-1] if len(first) else 0).combine_chunks().to_batches()
            held = held[0] if held else None
        if held is not None:
            yield _whole(pa.Table.from_batches([held]), np.zeros(1, np.int64))

    return runs.mapInArrow(run, "term string, range long, docs int, tf_max int, len_min int, offsets array<smallint>, tfs array<int>, lens array<int>")


def _whole(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
    """One row for the pieces from each of ``first`` on."""
    lists = [pa.concat_arrays(table[c].chunks) for c in ("offsets", "tfs", "lens")]
    offset, tf, n = (x.flatten().to_numpy() for x in lists)
    cuts = np.append(0, np.cumsum(lists[0].value_lengths().to_numpy()))[np.append(first, len(table))]
    of = np.repeat(np.arange(len(first)), np.diff(cuts))
    order = np.lexsort((offset, of))  # pieces need not come in the order of their documents
    made = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[order])) for x in (offset, tf, n)]
    numbers = [pa.array(x.astype(np.int32)) for x in (np.diff(cuts), np.maximum.reduceat(tf, cuts[:-1]), np.minimum.reduceat(n, cuts[:-1]))]
    heads = table.take(pa.array(first)).combine_chunks()
    return pa.RecordBatch.from_arrays([*(pa.concat_arrays(heads[c].chunks) for c in ("term", "range")), *numbers, *made], names=["term", "range", "docs", "tf_max", "len_min", "offsets", "tfs", "lens"])


def _entries(blocks: DataFrame) -> DataFrame:
    """(doc, term, tf, n) of blocks."""
    x = F.explode(F.arrays_zip("offsets", "tfs", "lens")).alias("x")
    return blocks.select("term", "range", x).select((F.col("range") * RANGE + F.col("x.offsets")).alias("doc"), "term", F.col("x.tfs").alias("tf"), F.col("x.lens").alias("n"))


def stored_search(index: StoredIndex, sessions: DataFrame, commands: DataFrame, projects: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """``index_search`` by the stored index: hits, lengths and counts come from it, and only hit sessions' commands are read, for the tiers."""
    live = index.docs().where("type = 'command'")
    hits = index.matching(query).where("type = 'command'").select("ref").distinct()
    of_hits = live.join(hits, "ref", "left_semi").select("doc", "ref", "n")
    lengths = of_hits.groupBy("ref").agg(F.sum("n").alias("n"))
    terms = [t.lower() for t in query.split()]
    tf = index.counts(terms, of_hits).join(of_hits.select("doc", "ref"), "doc").groupBy("ref", "term").agg(F.sum("tf").alias("tf"))
    stats = lengths.agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    times = F.element_at(F.create_map(*[F.lit(x) for t in sorted(set(terms)) for x in (t, terms.count(t))]), F.col("term"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1 + 1e-9)
    part = times * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / (F.col("total") / (F.col("docs") + 1e-9))))
    scored = tf.join(lengths, "ref").join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row for each term, and one
    ranked = scored.groupBy(F.col("ref").cast("long").alias("id")).agg(F.sum(part).alias("score"))
    ids = hits.select(F.col("ref").cast("long").alias("id"))
    chosen = sessions.join(ids, "id", "left_semi")
    tier = exactness_tier(chosen, commands.join(ids.withColumnRenamed("id", "session_id"), "session_id", "left_semi"), projects, query)
    out = chosen.join(tier, "id").join(ranked, "id", "left").fillna(0.0, ["score"])
    return out if limit is None else out.orderBy("tier", F.col("score").desc(), F.col("start_time").desc(), F.col("id").desc()).limit(limit)
