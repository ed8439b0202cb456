"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages become TF-IDF rows, with document frequencies counted over
the whole corpus. A randomised SVD, whose products with the passage matrix are
computed by Spark, gives a latent space. A window of a document that has some of
a passage's rarest words, its anchors, is folded into that space and compared
with the passage by cosine; no other window can hold most of its weight. What
comes close is checked word by word: the longest common subsequence with the
item, and whether the item's rarest words, which carry its answer, are there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.scratch import small_batches
from tidemark.llm.textkit import NOT_WORD, word_hashes

BITS = 18  # hashed words
RANK = 128
ROUNDS = 2  # of the range finder
CAPTURED = 0.5  # share of an item's squared length that its latent vector must keep; else it gets a space of its own
STEP = 32  # words between windows; a window is two steps long
PASSAGE = 48  # words in a passage of an item, half overlapping
FREQUENT = 0.05  # share of documents from which a word says nothing, unless its item has fewer than FEW others
FEW = 4
ITEMS = 4096  # items on the driver, and in a space, at a time
SENT_BYTES = 1 << 28  # of spaces searched in one pass over the documents
ANCHORS, SHARED = 12, 2  # of a passage, and how many of them a window must have (one, if there are fewer than FEW)
CLOSE, PART = 0.5, 0.4  # a candidate's least cosine, and the least part of the passage's length that it projects to
SAME, ALIKE, ANSWER = 0.8, 0.6, 0.5  # share of an item found in order; with less than SAME, the answer words count, too
ANSWER_WORDS = 6
SEGMENT = 1 << 17  # words of a document handled at once, and at least four times what the next segment repeats of them
SLICE = 256


def _word_buckets(texts: list[str | None]) -> list[np.ndarray]:
    return [(h >> np.uint64(64 - BITS)).astype(np.int64) for h in word_hashes([(t or "").lower() for t in texts], NOT_WORD)]


def document_frequency(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each hashed word occurs, and how many there are; summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << BITS) + 1, np.int64)  # the last one counts rows
        for batch in batches:
            seen[-1] += batch.num_rows
            for at in range(0, batch.num_rows, SLICE):
                for words in _word_buckets(batch.column(0).slice(at, SLICE).to_pylist()):
                    seen[np.unique(words)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["word", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((1 << BITS) + 1, np.int64)
    seen[counts["word"]] = counts["n"]
    return seen[:-1], int(seen[-1])


def _sparse(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(words[idf[words] > 0], return_counts=True)
    weight = n * idf[at]
    return at, weight / max(1e-12, np.sqrt((weight**2).sum()))


def _passages(words: np.ndarray) -> list[np.ndarray]:
    return [words[i : i + PASSAGE] for i in range(0, max(1, len(words) - PASSAGE // 2), PASSAGE // 2)]


def randomised_svd(items: DataFrame, text_col: str, idf: np.ndarray, rank: int = RANK, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(words, V): an orthonormal basis of the passages' leading right singular space, one row per word.

    A is passages x words. V starts random and becomes orth(A' (A V)) in each
    round; tasks multiply their passages and the products are summed by word.
    """
    words, basis = np.zeros(0, np.int64), np.zeros((0, rank))
    for k in range(rounds + 1):

        def run(batches: Iterator[pa.RecordBatch], words: np.ndarray = words, basis: np.ndarray = basis, k: int = k) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for item in _word_buckets(batch.column(0).to_pylist()):
                    for passage in _passages(item):
                        at, weight = _sparse(passage, idf)
                        if not len(at):
                            continue
                        if k:
                            left = weight @ basis[np.searchsorted(words, at)]
                        else:  # a random row of A x Omega, drawn from the passage itself
                            left = np.random.default_rng(at).standard_normal(rank)
                        for w, x in zip(at.tolist(), weight):
                            total[w] = total.get(w, 0) + x * left
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["word", "row"])

        parts = items.select(F.col(text_col).alias("text")).mapInArrow(run, "word int, row array<double>")
        summed = parts.select("word", F.posexplode("row")).groupBy("word", "pos").agg(F.sum("col").alias("x")).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).getField("x").alias("row"))
        got = summed.toPandas().sort_values("word")
        if not len(got):
            return np.zeros(0, np.int64), np.zeros((0, rank))
        words = got["word"].to_numpy().astype(np.int64)
        u, s, _ = np.linalg.svd(np.stack(got["row"].to_list()), full_matrices=False)
        basis = u * (s > 1e-9 * s[0])
    return words, basis


def _needed(items: DataFrame, telling: np.ndarray) -> np.ndarray:
    """Frequent words of items that have few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for w in _word_buckets(batch.column(0).to_pylist()) if (telling[np.unique(w)] > 0).sum() < FEW]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)) if found else [], pa.int32())], names=["word"])

    return items.select("text").mapInArrow(run, "word int").distinct().toPandas()["word"].to_numpy()


@dataclass(frozen=True)
class LatentIndex:
    """Some items, folded into the latent space."""

    row: np.ndarray  # of each hashed word in ``vectors``, or -1
    vectors: np.ndarray  # idf-weighted latent vectors of words
    passages: np.ndarray  # unit vectors
    strength: np.ndarray  # their length before
    item_of: np.ndarray
    items: list[list[int]]
    answers: list[list[int]]
    ids: list
    anchor: np.ndarray  # of each hashed word in ``posting``, or -1
    posting: np.ndarray  # where each anchor's passages begin in ``passage_of``
    passage_of: np.ndarray
    shared: np.ndarray  # anchors of each passage that a window must have

    def overlap(self) -> int:
        """Words that segments share, so that each item, with words put in, is whole in one of them."""
        return 2 * max(map(len, self.items), default=0) + 4 * STEP

    def size(self) -> int:
        return sum(x.nbytes for x in (self.row, self.vectors, self.passages, self.anchor, self.passage_of)) + 16 * sum(map(len, self.items))


def _index(ids: list, texts: list[str], words: np.ndarray, basis: np.ndarray, idf: np.ndarray) -> LatentIndex:
    row = np.full(1 << BITS, -1, np.int32)
    row[words] = np.arange(len(words))
    items = _word_buckets(texts)
    passages, strength, item_of, anchors = [], [], [], []
    for k, item in enumerate(items):
        for passage in _passages(item):
            at, weight = _sparse(passage, idf)
            vector = weight @ basis[row[at]] if len(at) else np.zeros(basis.shape[1])
            if (norm := np.sqrt((vector**2).sum())) > 1e-9:
                passages.append(vector / norm)
                strength.append(norm * np.sqrt((idf[passage] ** 2).sum()))
                item_of.append(k)
                anchors.append(at[np.argsort(-idf[at], kind="stable")[:ANCHORS]])
    answers = []
    for item in items:
        distinct = np.unique(item)
        answers.append(distinct[np.argsort(-idf[distinct], kind="stable")[:ANSWER_WORDS]].tolist())
    vectors = (basis * idf[words][:, None]).astype(np.float32)
    sizes = np.array([len(x) for x in anchors], np.int64)
    word, passage = np.concatenate(anchors) if anchors else np.zeros(0, np.int64), np.repeat(np.arange(len(anchors)), sizes)
    order = np.argsort(word, kind="stable")
    own, first = np.unique(word[order], return_index=True)
    anchor = np.full(1 << BITS, -1, np.int32)
    anchor[own] = np.arange(len(own))
    return LatentIndex(
        row, vectors, np.array(passages, np.float32).reshape(-1, basis.shape[1]), np.array(strength, np.float32), np.array(item_of, np.int64), [x.tolist() for x in items], answers, ids,
        anchor, np.append(first, len(word)), passage[order], np.where(sizes < FEW, 1, SHARED),
    )


def _spaces(spark: SparkSession, block: list, idf: np.ndarray) -> list[LatentIndex]:
    """The items of a block in one latent space, or, where it doesn't show some of them well, in further ones of their own."""
    out, left = [], block
    while left:
        words, basis = randomised_svd(spark.createDataFrame([(r["text"],) for r in left], "text string").repartition(16), "text", idf)
        row = np.full(1 << BITS, -1, np.int32)
        row[words] = np.arange(len(words))
        kept = []
        for item in _word_buckets([r["text"] for r in left]):
            parts = [_sparse(p, idf) for p in _passages(item)]
            kept.append(min((float(((w @ basis[row[at]]) ** 2).sum()) for at, w in parts if len(at)), default=1.0))
        order = np.argsort(-np.array(kept), kind="stable")
        fits = [i for n, i in enumerate(order) if kept[i] >= CAPTURED or n < RANK // 2]
        out.append(_index([left[i]["item"] for i in fits], [left[i]["text"] for i in fits], words, basis, idf))
        left = [left[i] for i in sorted(set(range(len(left))) - set(fits))]
    return out


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, one machine word operation per text word (bit-parallel)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    state = full
    for w in text:
        if m := masks.get(w):
            u = state & m
            state = (state + u | state - u) & full
    return len(item) - state.bit_count()


def _close(words: np.ndarray, index: LatentIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (by their number) and passages that are close in the latent space, and their cosines, largest first."""
    at = np.flatnonzero(index.anchor[words] >= 0)
    hit = index.anchor[words[at]]
    n = index.posting[hit + 1] - index.posting[hit]
    begin = np.cumsum(n) - n
    passage = index.passage_of[np.arange(n.sum()) - np.repeat(begin - index.posting[hit], n)]
    word, block = np.repeat(words[at], n), np.repeat(at // STEP, n)
    last = max(0, (len(words) - 1) // STEP - 1)
    # Each word is in two windows, but for those at the ends; a window counts each anchor once.
    window, passage, word = np.concatenate((np.minimum(block, last), np.maximum(block - 1, 0))), np.tile(passage, 2), np.tile(word, 2)
    pairs = np.unique((window * len(index.passages) + passage) << BITS | word) >> BITS
    pairs, shared = np.unique(pairs, return_counts=True)
    w, p = np.divmod(pairs, len(index.passages))
    keep = shared >= index.shared[p]
    w, p = w[keep], p[keep]
    own, of = np.unique(w, return_inverse=True)
    folded = np.zeros((len(own), index.vectors.shape[1]), np.float32)
    for i, k in enumerate(own.tolist()):
        row = index.row[words[k * STEP : (k + 2) * STEP]]
        folded[i] = index.vectors[row[row >= 0]].sum(axis=0)
    along = np.einsum("ij,ij->i", folded[of], index.passages[p])
    cosine = along / np.maximum(np.sqrt(np.einsum("ij,ij->i", folded, folded)), 1e-12)[of]
    keep = (along >= PART * index.strength[p]) & (cosine >= CLOSE)
    order = np.flatnonzero(keep)[np.argsort(-cosine[keep], kind="stable")]
    return w[order], p[order], cosine[order]


def find_items(words: np.ndarray, index: LatentIndex) -> dict[int, tuple[float, float]]:
    """Items found in a text: their share found in order, and the cosine that led to it."""
    found: dict[int, tuple[float, float]] = {}
    if not len(words) or not len(index.passages):
        return found
    for w, p, cosine in zip(*(x.tolist() for x in _close(words, index))):
        k, begin = int(index.item_of[p]), w * STEP
        item = index.items[k]
        if found.get(k, (0,))[0] >= SAME:
            continue
        lo, hi = max(0, begin - len(item)), begin + 2 * STEP + len(item)
        text = words[lo:hi].tolist()
        near = set(text)
        if sum(x in near for x in item) < ALIKE * len(item):
            continue
        share = common_subsequence(item, text) / len(item)
        if share >= SAME or share >= ALIKE and sum(x in near for x in index.answers[k]) >= ANSWER * len(index.answers[k]):
            found[k] = max(found.get(k, (0.0, 0.0)), (share, float(cosine)))
    return found


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: ``id_col``, ``item_col``, share and cosine.

    ``share`` is the part of the item's words found in order near the window,
    punctuation and case aside. Whole documents are searched, long ones in
    segments that overlap by more than the longest item; all items are searched
    in one pass, as far as their spaces fit SENT_BYTES. Null, empty or wordless
    texts and items match nothing. Rows that repeat a document are searched
    each; equal items are found each. Other columns are ignored; empty tables
    give an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = f"id {id_type.simpleString()}, item {item_type.simpleString()}, share double, cosine double"
    wanted = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where(F.length(F.trim("text")) > 0)
    frequency, rows = document_frequency(docs, text_col)
    idf = np.log((rows + 1) / (frequency + 1)).astype(np.float32)
    telling = np.where(frequency > FREQUENT * rows, np.float32(0), idf)
    needed = _needed(wanted, telling)
    telling[needed] = np.maximum(idf[needed], 0.01)
    out, block, spaces = spark.createDataFrame([], schema), [], []

    def search(indexes: list[LatentIndex]) -> DataFrame:
        kind = to_arrow_type(item_type)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, items_found, shares, cosines = [], [], [], []
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    for i, text in enumerate(_word_buckets(part.column(1).to_pylist())):
                        for index in indexes:
                            found: dict[int, tuple[float, float]] = {}
                            overlap = index.overlap()
                            segment = max(SEGMENT, 4 * overlap)
                            for lo in range(0, max(1, len(text) - overlap), segment):
                                for k, x in find_items(text[lo : lo + segment + overlap], index).items():
                                    found[k] = max(found.get(k, x), x)
                            for k, (share, cosine) in found.items():
                                ids.append(at + i)
                                items_found.append(index.ids[k])
                                shares.append(share)
                                cosines.append(cosine)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(items_found, kind), pa.array(shares, pa.float64()), pa.array(cosines, pa.float64())], names=["id", "item", "share", "cosine"])

        return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)

    for row in wanted.toLocalIterator():
        block.append(row)
        if len(block) == ITEMS:
            spaces += _spaces(spark, block, telling)
            block = []
            if sum(x.size() for x in spaces) > SENT_BYTES:
                out, spaces = out.union(search(spaces)), []
    if block:
        spaces += _spaces(spark, block, telling)
    if spaces:
        out = out.union(search(spaces))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "share", "cosine")
