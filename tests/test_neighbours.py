"""Neighbours against all products."""

import numpy as np
import pytest

from tidemark.operators import neighbours as N

KIND = "vec_id long, embedding array<float>"


def table(spark, seed=1, n=1500, dim=16, hot=0):
    """Vectors around some centres, ``hot`` copies of one, and zero vectors."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(20, dim))[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dim))
    m[: hot or 1] = m[0]
    m[-2:] = 0
    m = m.astype(np.float32)
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], KIND).repartition(3)


def plain(m, queries, k):
    u = N._unit(m.tolist())
    out = {}
    for q in queries:
        scores = np.round(u[q] @ u.T, N.DIGITS)
        order = np.lexsort((np.arange(len(m)), -scores))[:k]
        out[q] = [(int(i), round(float(scores[i]), 6)) for i in order]
    return out


def got(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    return {q: sorted(x, key=lambda y: (-y[1], y[0])) for q, x in out.items()}


@pytest.mark.parametrize("hot", [0, 700])
def test_exact_neighbours(spark, hot):
    m, rows = table(spark, hot=hot)
    index = N.build_cells(rows, "vec_id", "embedding", cells=24)
    queries = list(range(0, 1500, 50)) + [1499]
    asked = rows.where("vec_id % 50 = 0 OR vec_id = 1499")
    assert got(N.nearest_neighbours(index, asked, "vec_id", "embedding", k=7, probes=1)) == plain(m, queries, 7)


def test_recall_of_few_probes(spark):
    m, rows = table(spark, seed=2)
    index = N.build_cells(rows, "vec_id", "embedding", cells=24)
    want = plain(m, range(0, 1450, 50), 10)
    found = got(N.nearest_neighbours(index, rows.where("vec_id % 50 = 0 AND vec_id < 1450"), "vec_id", "embedding", probes=4, exact=False))
    recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9


def test_small_and_odd_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0])], KIND)
    index = N.build_cells(rows, "vec_id", "embedding")
    assert sum(len(r.ids) for r in index.blocks.collect()) == 4
    found = got(N.nearest_neighbours(index, rows.where("vec_id <> 2"), "vec_id", "embedding", k=3))
    assert found == {1: [(1, 1.0), (2, 0.0), (2, 0.0)], 4: [(1, 0.0), (2, 0.0), (2, 0.0)]}
    empty = N.build_cells(rows.where("vec_id > 9"), "vec_id", "embedding")
    assert N.nearest_neighbours(empty, rows.where("vec_id > 9"), "vec_id", "embedding").count() == 0
