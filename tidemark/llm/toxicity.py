"""Toxicity by weak supervision.

Lexicon and pattern voters look at each training text; a generative model
estimates how accurate and how correlated they are by expectation-maximisation,
without knowing any truth; its posteriors train a linear classifier on hashed
words. A given label is one more voter, as fallible as its agreement with the
others shows. Lexicons of words and of beginnings of words that vote on a fold
of the training rows are drawn from the other folds, so no row votes for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import row_draw, small_batches, written
from tidemark.llm.textkit import NOT_WORD, hash_spans, lowered, spans, word_hashes
from tidemark.llm.weak import ABSTAIN, NO, YES, Linear, VoteModel, fit_linear, fit_votes

BITS = 18  # hashed words and, in the upper half, word beginnings
FOLDS = 5  # of the training rows, by a hash of the text, so that copies are in the same
SENT_LABELS = 1_000_000  # labels sent to every task; more are joined by a shuffle, once
FIT_ROWS = 24_000  # labelled rows, on average at most, that the linear classifier is fitted on
PSEUDO = 4
TELLING = 2.0  # log-odds from which a feature is in the classifier
STEMS = (6, 8)  # bytes of a word's beginnings
SLICE = 256

# Common English insults.
INSULTS = [
    "arsehole", "ass", "asshole", "bastard", "bitch", "bozo", "brainless", "bullshit", "clown", "coward", "crap", "creep", "cretin", "cunt", "damn", "despicable", "dickhead",
    "dimwit", "dirtbag", "disgrace", "disgusting", "douchebag", "dumb", "dumbass", "dunce", "fool", "fuck", "fucking", "garbage", "hate", "hateful", "idiot", "idiotic", "idiots",
    "ignorant", "imbecile", "jackass", "jerk", "lame", "liar", "loathsome", "loser", "losers", "lunatic", "moron", "moronic", "morons", "nasty", "nitwit", "parasite", "pathetic",
    "pig", "piss", "prick", "psycho", "repulsive", "retard", "retarded", "rotten", "scum", "scumbag", "shit", "shut", "sicko", "slut", "stupid", "stupidity", "sucker", "sucks",
    "swine", "traitor", "trash", "twat", "ugly", "useless", "vermin", "vile", "wanker", "weasel", "whore", "worthless", "wretch",
]


def features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct hashed words, and beginnings of words, of each text."""
    out = []
    shift, upper = np.uint64(65 - BITS), np.uint64(1 << (BITS - 1))
    for text in texts:
        text = (text or "").lower()
        whole = word_hashes([text], NOT_WORD)[0]
        raw = np.frombuffer(lowered(text), np.uint8)
        start, end = spans(raw, NOT_WORD)
        stems = [hash_spans(raw, start[long], start[long] + n) for n in STEMS if (long := end - start > n).any()]
        out.append(np.unique(np.concatenate((whole >> shift, *((h >> shift) + upper for h in stems)))).astype(np.int64))
    return out


def _evidence(labelled: DataFrame) -> np.ndarray:
    """For each fold of the labelled rows: how much a feature raises the log-odds of a toxic text in the other folds.

    PSEUDO rows at the base rate stand behind each feature, so that a rare one says little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((FOLDS, 2, (1 << BITS) + 1), np.int64)  # the last column counts rows
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for label, fold, found in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), features(part.column(0).to_pylist())):
                    seen[fold, label][found] += 1
                    seen[fold, label][-1] += 1
        flat = seen.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.int64())], names=["key", "n"])

    # One row for each feature, with a column for each fold and label, so that few rows reach the driver.
    feature, slot = F.pmod("key", F.lit((1 << BITS) + 1)), F.floor(F.col("key") / ((1 << BITS) + 1))
    slots = [F.coalesce(F.sum(F.when(slot == k, F.col("n"))), F.lit(0)).cast("int").alias(f"n{k}") for k in range(2 * FOLDS)]
    counts = labelled.mapInArrow(run, "key int, n bigint").groupBy(feature.alias("feature")).agg(*slots).toPandas()
    n = np.zeros((2 * FOLDS, (1 << BITS) + 1), np.int32)
    n[:, counts["feature"]] = counts[[f"n{k}" for k in range(2 * FOLDS)]].to_numpy().T
    n = n.reshape(FOLDS, 2, -1)
    n = n.sum(0) - n
    base = np.clip((n[:, 1, -1:] + 0.5) / (n[:, :, -1].sum(1, keepdims=True) + 1), 1e-4, 0.5)
    share = (n[:, 1, :-1] + PSEUDO * base) / (n[:, :, :-1].sum(1) + PSEUDO)
    return (np.log(share / (1 - share)) - np.log(base / (1 - base))).astype(np.float32)


def _loud(text: str) -> bool:
    """Whether most letters of the whole text are upper-case."""
    low, high = text.lower(), text.upper()
    if len(low) != len(text) or len(high) != len(text):  # the case of some letters has other lengths
        text = "".join(c for c in text if len(c.lower()) == len(c.upper()) == 1)
        low, high = text.lower(), text.upper()
    own, low, high = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (text, low, high))
    return int((own != low).sum()) * 2 > int((low != high).sum()) > 0


def _votes(found: np.ndarray, odds: np.ndarray, insults: np.ndarray, text: str, label: int) -> list[int]:
    """What each voter says of a text; ``odds`` come from the other folds of the rows."""
    own = odds[found]
    words, stems = own[found < 1 << (BITS - 1)], own[found >= 1 << (BITS - 1)]
    strong, strongest = int((own > 2.5).sum()), float(own.max(initial=0))
    hits = int(np.isin(found, insults).sum())
    return [
        YES if (words > 2.5).any() else ABSTAIN,
        YES if (stems > 2.5).any() else ABSTAIN,
        YES if strong > 1 else ABSTAIN,
        YES if (own > 1.5).sum() > 2 else ABSTAIN,
        YES if strong * 100 > len(found) else ABSTAIN,
        NO if strongest < 1 else ABSTAIN,
        YES if hits else ABSTAIN,
        YES if hits > 1 else ABSTAIN,
        YES if text.count("!") * 20 > len(text) > 0 else ABSTAIN,
        YES if _loud(text) else ABSTAIN,
        NO if len(found) < 4 and not hits else ABSTAIN,
        YES if label else NO,
    ]


@dataclass(frozen=True)
class ToxicityModel:
    linear: Linear | None
    votes: VoteModel | None
    rate: float  # of toxic rows


def _fit_rows(labelled: DataFrame, odds: np.ndarray) -> DataFrame:
    insults = np.unique(np.concatenate(features(INSULTS)))
    insults = insults[insults < 1 << (BITS - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts, labels, folds = (part.column(i).to_pylist() for i in (0, 1, 3))
                found = features(texts)
                votes = [_votes(f, odds[k], insults, t or "", y) for f, t, y, k in zip(found, texts, labels, folds)]
                telling = odds.max(0) > TELLING
                yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, v)) for v in votes]), part.column(1), pa.array([f[telling[f]] for f in found], pa.list_(pa.int32())), part.column(2)], names=["votes", "label", "found", "pick"])

    return labelled.mapInArrow(run, "votes string, label int, found array<int>, pick double")


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents with the columns of their labels; those without one are left out."""
    if labels.count() <= SENT_LABELS:
        return docs.join(F.broadcast(labels), id_col)
    return written(docs.join(labels, id_col), "labelled")


def train_toxicity(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> ToxicityModel:
    """Learn from rows with a label of 0 or 1; rows with a null label are left out, repeated ones count each.

    Lexicons and vote counts cover all labelled rows; only the linear fit takes
    FIT_ROWS of them, half from each label as far as there are so many, weighted
    to stand for all. Its targets are the label model's posteriors. What reaches
    the driver is bounded by the number of hashed features, of vote patterns,
    and FIT_ROWS.
    """
    small_batches(labelled.sparkSession)
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col(text_col)), F.lit(FOLDS)).cast("int")
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), row_draw(id_col, text_col).alias("pick"), fold.alias("fold"))
    odds = _evidence(rows)
    voted = written(_fit_rows(rows, odds), "voted")
    table = voted.groupBy("votes", "label").count().toPandas()
    if not len(table):
        return ToxicityModel(None, None, 0.0)
    votes = np.array([[int(c) for c in v] for v in table["votes"]])
    counts, label = table["count"].to_numpy(), table["label"].to_numpy()
    rate = float((counts * label).sum() / counts.sum())
    model = fit_votes(votes, counts, prior=min(0.5, max(rate, 1e-3)), apart=(votes.shape[1] - 1,), restarts=1)
    total = {k: int(counts[label == k].sum()) for k in (0, 1)}
    chance = {k: min(1.0, FIT_ROWS / 2 / max(1, total[k])) for k in (0, 1)}
    fit = voted.where(F.col("pick") < F.when(F.col("label") == 1, chance[1]).otherwise(chance[0])).select("votes", "label", "found").toPandas()
    if not len(fit):
        return ToxicityModel(None, model, rate)
    soft = model.posterior(np.array([[int(c) for c in v] for v in fit["votes"]]))
    weight = np.where(fit["label"].to_numpy() == 1, 1 / chance[1], 1 / chance[0])
    lengths = fit["found"].map(len).to_numpy()
    cols = np.concatenate(fit["found"].to_list()).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    linear = fit_linear(np.repeat(np.arange(len(fit)), lengths), cols, np.ones(len(cols)), soft, weight, 1 << BITS, ridge=1e-6)
    return ToxicityModel(linear, model, rate)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and score (0 to 1), from the whole text alone.

    Null and empty texts have no words and get the classifier's bias; a model
    without labelled rows scores everything 0. Ids are passed through; other
    columns are ignored; an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    linear = model.linear

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, SLICE):
                for found in features(batch.column(1).slice(at, SLICE).to_pylist()) if linear else []:
                    scores.append(1 / (1 + np.exp(-np.clip(float(linear.weights[found].sum()) + linear.bias, -50, 50))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores if linear else [0.0] * batch.num_rows, pa.float64())], names=["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, score double")
    return out.withColumnRenamed("id", id_col)
