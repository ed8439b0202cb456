"""Quality classification from weak labels.

Overlapping heuristics vote on every document; expectation-maximisation
estimates how accurate each is without any given label; the posterior labels
train a linear scorer on hashed word shapes, which scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import row_draw, small_batches
from tidemark.llm.textkit import hash_spans, mix, spans, word_hashes
from tidemark.llm.weak import ABSTAIN, NO, YES, Linear, VoteModel, fit_linear, fit_votes

BITS = 14  # hashed shapes and pairs of shapes
FIT_ROWS = 12_000  # documents, on average at most, that the linear scorer is fitted on
PRIOR = 0.8  # share of good documents from which the estimation starts
_U = np.uint64

# The class of each byte: letters of either case, digits, white space; any other byte is its own class.
_CLASS = np.arange(256).astype(np.uint8)
_CLASS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[[9, 11, 12, 13]] = ord(" ")
_MARKS = ~np.isin(np.arange(256), [*map(ord, "aA0 \n.,;:!?'\"-()")])
REPEATS = 1 << BITS  # the feature after the hashed ones: words that repeat the one before
VOTERS = 11


def votes(text: str | None) -> list[int]:
    """What each heuristic says of a whole text."""
    return _look(text)[2]


def shapes(text: str | None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Features (hashed shapes and pairs, with their share of all words) and the votes on a whole text.

    A word's shape is its byte classes with repeats collapsed, so ``Then###`` is ``Aa#``.
    """
    raw, own, said = _look(text)
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0), said
    short = raw[np.flatnonzero(raw[1:] != raw[:-1])]
    short = np.append(short, raw[-1])
    h = hash_spans(short, *spans(short))
    pairs = mix(h[:-1] * _U(3) + h[1:])
    n = np.bincount((np.concatenate((h, pairs)) >> _U(64 - BITS)).astype(np.int64), minlength=REPEATS + 1)
    n[REPEATS] = (own[1:] == own[:-1]).sum()
    at = np.flatnonzero(n)
    return at, n[at] / len(own), said


def _look(text: str | None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Byte classes, word hashes and votes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = _CLASS[np.frombuffer(data, np.uint8)]
    own = word_hashes([text])[0]
    if not len(own):
        return raw, own, [NO] + [ABSTAIN] * (VOTERS - 1)
    seen = np.bincount(raw, minlength=256)
    words, total, lines = len(own), len(raw) - int(seen[32]), int(seen[10]) + 1
    capital, lower, digit, bar, bang, mark = int(seen[65]), int(seen[97]), int(seen[48]), int(seen[124]), int(seen[33]), int(seen[_MARKS].sum())
    letter, stops = capital + lower, int(seen[[46, 63, 33]].sum())
    repeats = int((own[1:] == own[:-1]).sum())
    return raw, own, [
        NO if mark * 20 > total else ABSTAIN,
        NO if bar * 12 > words else ABSTAIN,
        NO if capital * 2 > letter else ABSTAIN,
        NO if bang * 8 > words else ABSTAIN,
        NO if not 2 <= letter / words <= 14 else ABSTAIN,
        NO if digit * 5 > total else ABSTAIN,
        NO if words > 60 and not stops else ABSTAIN,
        NO if lines * 2 > words > 20 else ABSTAIN,
        YES if lower * 10 > 9 * total else NO if lower * 10 < 8 * total else ABSTAIN,
        YES if stops and 2 <= words / stops <= 60 and mark * 50 < total and not bar else ABSTAIN,
        NO if repeats * 8 > words > 4 else ABSTAIN,
    ]


@dataclass(frozen=True)
class QualityModel:
    linear: Linear | None
    votes: VoteModel | None


def _voted(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, votes(t))) for t in batch.column(0).to_pylist()])], names=["votes"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "votes string")


def train_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Vote counts cover all documents; the scorer is fitted on FIT_ROWS of them.

    The driver gets one row per pattern of votes and the texts' features of the
    fitted rows only. An empty table gives a model that scores everything 0.
    """
    small_batches(docs.sparkSession)
    table = _voted(docs, text_col).groupBy("votes").count().toPandas()
    if not len(table):
        return QualityModel(None, None)
    counts = table["count"].to_numpy()
    model = fit_votes(np.array([[int(c) for c in v] for v in table["votes"]]), counts, prior=PRIOR, better=3.0)
    drawn = docs.select(F.col(text_col).alias("text"), row_draw(id_col, text_col).alias("pick"))
    chosen = drawn.where(F.col("pick") < min(1.0, FIT_ROWS / counts.sum())).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shapes(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, v)) for _, _, v in got]), pa.array([a for a, _, _ in got], pa.list_(pa.int32())), pa.array([s for _, s, _ in got], pa.list_(pa.float32()))], names=["votes", "at", "share"])

    fit = chosen.mapInArrow(run, "votes string, at array<int>, share array<float>").toPandas()
    if not len(fit):
        return QualityModel(None, model)
    soft = model.posterior(np.array([[int(c) for c in v] for v in fit["votes"]]))
    lengths = fit["at"].map(len).to_numpy()
    columns, shares = np.concatenate(fit["at"].to_list()).astype(np.int64), np.concatenate(fit["share"].to_list())
    linear = fit_linear(np.repeat(np.arange(len(fit)), lengths), columns, shares, soft, np.ones(len(fit)), REPEATS + 1, ridge=1e-6, rounds=300)
    return QualityModel(linear, model)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, score (chance of good quality) and good (score of 0.5 or more).

    Null, empty and blank texts score 0, and so does everything under an empty
    model. Ids are passed through, null or repeated; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    linear = model.linear

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                at, share, _ = shapes(text)
                z = float((linear.weights[at] * share).sum()) + linear.bias if linear and len(at) else -np.inf
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -700, 50)))) if z > -np.inf else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([s >= 0.5 for s in scores])], names=["id", "score", "good"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, score double, good boolean")
    return out.withColumnRenamed("id", id_col)
