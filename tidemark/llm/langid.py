"""Language identification by mixture inference.

A document is a mixture of languages: each word is drawn from one of them with
the document's proportions, and its character trigrams have that language's
frequencies. Expectation-maximisation estimates the proportions; nested sets of
languages, largest share first, are compared by likelihood less a penalty for
each language, and the best set stays. However many languages a text has, a
further one is tried as long as the likelihood's upper bound, each word at its
best, leaves room for its penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import small_batches

BUCKETS = 1 << 16  # hashed trigrams
SMOOTHING = 0.5
ROUNDS = 6  # of expectation-maximisation for each set of languages
PENALTY = 3.0  # times half the logarithm of the number of words, for each language
CHUNK = 400_000  # characters taken together; a longer text is one chunk
UNKNOWN = "und"


def _has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    columns: list[np.ndarray]  # log-probability of each bucket, by language


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and word of each trigram, and text of each word; a trigram belongs to the word of its middle character."""
    joined = " " + "  ".join(t.lower() for t in texts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (code == 32) | ((code >= 9) & (code <= 13)) | (code == 0xA0)
    code = np.where(space, np.uint32(32), code)
    h = (code[:-2] * np.uint32(0x9E3779B1)) ^ (code[1:-1] * np.uint32(0x85EBCA77)) ^ (code[2:] * np.uint32(0xC2B2AE3D))
    bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    starts = ~space[1:-1] & space[:-2]
    word = np.cumsum(starts) - 1
    keep = ~space[1:-1]
    ends = np.cumsum([len(t.lower()) + 2 for t in texts])
    text = np.searchsorted(ends, np.flatnonzero(starts) + 1, side="right")
    return bucket[keep].astype(np.int64), word[keep], text


def _chunks(items: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of (text, ...) of CHUNK characters at most, or of one text."""
    held, size = [], 0
    for item in items:
        if held and size + len(item[0]) > CHUNK:
            yield held
            held, size = [], 0
        held.append(item)
        size += len(item[0])
    if held:
        yield held


def train_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Trigram frequencies of each language over all rows with a text and a language.

    Each task sums its counts before the shuffle; what comes to the driver is
    one number per bucket and language, however many rows there are.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append((text,))
            for lang, items in by_lang.items():
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for chunk in _chunks(items):
                    total += np.bincount(_trigrams([t for (t,) in chunk])[0], minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    columns = []
    for lang in languages:
        own = counts[counts["lang"] == lang]
        column = np.full(BUCKETS, SMOOTHING)
        column[own["bucket"]] += own["n"]
        columns.append(np.log(column / column.sum()).astype(np.float32))
    return LanguageModel(languages, columns)


def infer_mixtures(texts: list[str], model: LanguageModel) -> list[tuple[list[int], list[float]]]:
    """For each text, its languages by falling share, and their shares; nothing for a text without words."""
    bucket, word, text = _trigrams(texts)
    count = len(texts)
    if not len(word):
        return [([], [])] * count
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    log_lik = np.stack([np.add.reduceat(column[bucket], starts) for column in model.columns])  # languages x words
    top = log_lik.max(axis=0)
    lik = np.exp(log_lik - top)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    has = text[first]
    words = np.diff(np.append(first, len(text)))

    def fit(which: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares (languages x texts) and log-likelihood of the texts ``which``, with the allowed languages only."""
        n = words[which]
        at = np.repeat(np.arange(len(which)), n)
        begin = np.cumsum(n) - n
        own = slice(None) if len(which) == len(has) else np.arange(n.sum()) + np.repeat(first[which] - begin, n)
        likely, base = lik[:, own], top[own]
        share = (allowed / allowed.sum(axis=0)).astype(np.float32)
        for _ in range(ROUNDS):
            joint = likely * share[:, at]
            joint /= np.maximum(joint.sum(axis=0), np.float32(1e-30))
            share = np.add.reduceat(joint, begin, axis=1) / n.astype(np.float32)
        norm = (likely * share[:, at]).sum(axis=0)
        return share, np.add.reduceat(np.log(np.maximum(norm, np.float32(1e-30))).astype(np.float64) + base, begin)

    everything = np.arange(len(has))
    share, _ = fit(everything, np.ones((len(model.languages), len(has))))
    rank = np.argsort(np.argsort(-share, axis=0, kind="stable"), axis=0)
    # One language needs no fitting; more are tried where the first round leaves them a share.
    single = np.stack([np.add.reduceat(row.astype(np.float64), first) for row in log_lik])
    chosen = (rank == 0).astype(np.float32)
    most = np.add.reduceat(top.astype(np.float64), first)  # no mixture is likelier than each word's best language
    best = (single * chosen).sum(axis=0) - PENALTY * 0.5 * np.log(words + 1)
    for k in range(2, len(model.languages) + 1):
        which = everything[most - PENALTY * 0.5 * k * np.log(words + 1) > best]
        if not len(which):
            break
        fitted, value = fit(which, (rank < k)[:, which].astype(float))
        value = value - PENALTY * 0.5 * k * np.log(words[which] + 1)
        better = value > best[which]
        best[which[better]] = value[better]
        chosen[:, which[better]] = fitted[:, better]
    out: list[tuple[list[int], list[float]]] = [([], []) for _ in range(count)]
    for i, d in enumerate(has.tolist()):
        langs = [int(k) for k in np.argsort(-chosen[:, i], kind="stable") if chosen[k, i] > 0]
        out[d] = (langs, [float(min(1.0, chosen[k, i])) for k in langs])
    return out


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, lang_pred, score, languages and shares.

    ``languages`` is the chosen set by falling share, lang_pred its first and
    score that one's share. A null text, a text without a letter and any text
    under a model without languages are ``und`` with score 0 and no languages.
    The whole text counts. Ids are passed through (null, repeated or not);
    other columns are ignored; an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[list[int], list[float]]] = [([], [])] * batch.num_rows
            texts = batch.column(1).to_pylist()
            items = [(t, i) for i, t in enumerate(texts) if _has_letter(t)] if model.languages else []
            for chunk in _chunks(items):
                for (_, i), mix in zip(chunk, infer_mixtures([t for t, _ in chunk], model)):
                    found[i] = mix
            langs = [[model.languages[k] for k in x] for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] if x else UNKNOWN for x in langs], pa.string()), pa.array([s[0] if s else 0.0 for _, s in found], pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array([s for _, s in found], pa.list_(pa.float64()))],
                names=["id", "lang_pred", "score", "languages", "shares"],
            )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, lang_pred string, score double, languages array<string>, shares array<double>")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether the crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder
