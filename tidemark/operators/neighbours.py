"""Nearest neighbours by cosine for many queries: an inverted file of trained cells, exact by residual bounds.

Every vector lies in the cell of its nearest centre, cells are cut into blocks
of vectors in the order of their residuals (distances from the centre). As
``q . x <= q . c + |x - c|`` for a query of length one, a cell or block whose
bound is below a query's k-th score so far cannot better it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import numbered
from tidemark.tables import small_batches, written

SAMPLE = 20_000  # vectors, on average, from which the cells are trained
ROUNDS = 8
BLOCK_BYTES = 1 << 16  # of the vectors of a block, and of the queries that meet it at a time
PRODUCT = 512  # vectors that meet all centres at a time
HELD = 20_000  # queries whose best a task holds before it passes them on
DIGITS = 9  # scores that agree so far are ties, and the smaller id is nearer


@dataclass(frozen=True)
class Cells:
    """centres: a row for each cell; radius: the greatest residual of each; blocks: cell, block, reach, ids, vectors."""

    centres: np.ndarray
    radius: np.ndarray
    blocks: DataFrame


def _unit(vectors: list) -> np.ndarray:
    """Rows of length one; zero vectors stay."""
    m = np.array(vectors, float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def train_centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centres by a few rounds of Lloyd's method; fewer where the sample has fewer distinct vectors."""
    distinct = np.unique(sample, axis=0)
    if not len(distinct):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    rng = np.random.default_rng(seed)
    centres = distinct[rng.choice(len(distinct), min(cells, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        of = _nearest_centre(sample, centres)[0]
        n = np.bincount(of, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, of, sample)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector and its distance from the centre, by blocked products."""
    cell, far = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    half = (centres**2).sum(1) / 2
    for at in range(0, len(vectors), PRODUCT):
        v = vectors[at : at + PRODUCT]
        cell[at : at + PRODUCT] = best = np.argmax(v @ centres.T - half, axis=1)
        far[at : at + PRODUCT] = np.linalg.norm(v - centres[best], axis=1)
    return cell, far


def build_cells(vectors: DataFrame, id_col: str, vector_col: str, cells: int = 256) -> Cells:
    """Train on a sample of ``SAMPLE`` rows on average, then place every row.

    ``cells`` is a parameter, not a function of the table; null vectors are in no
    cell. Ids are whole numbers; repeated rows are in the index each.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    count = rows.count()
    drawn = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(1, count)))
    sample = [r.v for r in rows.where(drawn).collect()]
    centres = train_centres(_unit(sample) if sample else np.zeros((0, 0)), cells)
    if not len(centres):
        first = rows.limit(1).collect()  # a small table of which no row was drawn
        centres = _unit([first[0].v]) if first else centres

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _unit(batch.column("v").to_pylist())
                cell, far = _nearest_centre(v, centres)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell), pa.array(far), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "cell", "far", "v"])

    placed = numbered(rows.mapInArrow(place, "id long, cell long, far double, v binary"), ["cell"], ["far", "id"])
    cut = placed.groupBy("cell", F.floor(F.col("place") / _together(centres)).alias("block")).agg(F.max("far").alias("reach"), F.array_sort(F.collect_list(F.struct("place", "id", "v"))).alias("x"))  # at most BLOCK_BYTES of vectors
    blocks = written(cut.select("cell", "block", "reach", F.col("x.id").alias("ids"), F.col("x.v").alias("vectors")), "cells")
    radius = np.full(len(centres), -np.inf)
    for r in blocks.groupBy("cell").agg(F.max("reach").alias("r")).collect():  # a row for each cell
        radius[r.cell] = r.r
    return Cells(centres, radius, blocks)


def _together(centres: np.ndarray) -> int:
    """Vectors in BLOCK_BYTES."""
    return max(8, BLOCK_BYTES // (8 * max(1, centres.shape[1])))


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs)).reshape(len(blobs), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _scored(blocks: DataFrame, pairs: DataFrame, k: int, together: int) -> DataFrame:
    """(q, id, score): the k best of each query over the cells that ``pairs`` (q, v, cell, dot, least) name."""
    dealt = numbered(pairs, ["cell"], ["q"]).groupBy("cell", F.floor(F.col("place") / together).alias("part"))
    dealt = dealt.agg(F.collect_list(F.struct("q", "v", "dot", "least")).alias("asked"))  # at most `together`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def passed_on() -> pa.RecordBatch:
            sizes = [len(s) for _, s in held.values()]
            q = np.repeat(np.array(list(held), np.int64), sizes)
            parts = [np.concatenate([x[i] for x in held.values()]) if held else np.zeros(0) for i in (0, 1)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(parts[0].astype(np.int64)), pa.array(parts[1])], ["q", "id", "score"])

        for batch in batches:
            for asked, reach, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("asked", "reach", "ids", "vectors"))):
                open_ones = [a for a in asked if a["dot"] + reach >= a["least"]]
                if not open_ones:
                    continue
                scores = np.round(_matrix([a["v"] for a in open_ones]) @ _matrix(vectors).T, DIGITS)
                ids = np.array(ids, np.int64)
                for a, s in zip(open_ones, scores):
                    some = np.flatnonzero(s >= max(a["least"], np.partition(s, -k)[-k] if len(s) > k else -np.inf))
                    before = held.get(a["q"], (np.zeros(0, np.int64), np.zeros(0)))
                    held[a["q"]] = _best(np.r_[before[0], ids[some]], np.r_[before[1], s[some]], k)
            if len(held) > HELD:
                yield passed_on()
        yield passed_on()

    joined = dealt.join(blocks, "cell").select("asked", "reach", "ids", "vectors")
    return _top(joined.mapInArrow(run, "q long, id long, score double"), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, of at most k from each task."""
    kept = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("x"))
    return kept.select("q", F.explode("x").alias("x")).select("q", F.col("x.id").alias("id"), (-F.col("x.s")).alias("score"))


def nearest_neighbours(index: Cells, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, probes: int = 4, exact: bool = True) -> DataFrame:
    """(query_id, id, score): the ``k`` nearest of each query, itself included where it is in the index.

    First each query's ``probes`` best cells are opened. With ``exact``, so are
    then all other cells and blocks whose bound is not below its k-th score.
    Zero vectors score 0 with all; null queries have no rows. Query ids should be
    unique.
    """
    centres, radius = index.centres, index.radius
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("q"), F.col(vector_col).cast("array<double>").alias("v"))

    def cells(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _unit(batch.column("v").to_pylist()) if batch.num_rows else np.zeros((0, centres.shape[1]))
                dots = v @ centres.T
                some = radius > -np.inf
                order = np.argsort(-np.where(some, dots, -np.inf), axis=1, kind="stable")[:, :probes]
                near = np.zeros(dots.shape, bool)
                np.put_along_axis(near, order, True, axis=1)
                least = np.full(len(v), -np.inf) if first else batch.column("least").to_numpy(zero_copy_only=False)
                wanted = some & (near if first else ~near & (dots + radius >= least[:, None]))
                row, cell = np.nonzero(wanted)
                blobs = [x.tobytes() for x in v]
                yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(row)), pa.array([blobs[i] for i in row], pa.binary()), pa.array(cell), pa.array(dots[row, cell]), pa.array(least[row])], ["q", "v", "cell", "dot", "least"])

        return run

    kind = "q long, v binary, cell long, dot double, least double"
    found = written(_scored(index.blocks, asked.mapInArrow(cells(True), kind), k, _together(centres)), "near")
    if exact:
        least = found.groupBy("q").agg(F.min("score").alias("s"), F.count("*").alias("n"))
        bound = F.when(F.col("n") >= k, F.col("s") - 10.0**-DIGITS).otherwise(F.lit(float("-inf")))
        again = asked.join(least, "q", "left").select("q", "v", F.coalesce(bound, F.lit(float("-inf"))).alias("least"))
        found = _top(found.unionByName(_scored(index.blocks, again.mapInArrow(cells(False), kind), k, _together(centres))), k)
    return found.select(F.col("q").alias("query_id"), "id", "score")
