"""The manifest against a plain recursive tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

KIND = "doc_id long, source string, text string, leaf string, row int"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_proofs(nodes):
    """(root, [siblings of each level] of each node)."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 16 : i - i % 16 + 16]
            proofs[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        nodes = [digest(nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], proofs


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = {i: digest([field(v) for v in r[:3]]) for i, r in enumerate(rows)}
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r[1], []).append(i)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, subroots = {}, []
    for g in order:
        groups[g].sort(key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i]))
        root, proofs = plain_proofs([leaf[i] for i in groups[g]])
        subroots.append(root)
        out |= {i: (leaf[i], root, p) for i, p in zip(groups[g], proofs)}
    root, tops = plain_proofs(subroots)
    above = dict(zip(order, tops))
    return sorted((str(rows[i][0]), x, sub, root, tuple(p + above[rows[i][1]])) for i, (x, sub, p) in out.items())


def got_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], KIND).repartition(4)
    found = merkle.merkle_manifest(docs, ["doc_id", "source", "text"]).withColumn("again", merkle.folded(F.col("leaf"), F.col("proof")))
    found = found.collect()
    assert all(r.again == r.root for r in found)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, tuple((x.left, x.right) for x in r.proof)) for r in found)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17, 1], [256], [257, 3, 4400], [n % 37 + 1 for n in range(20)], [300] * 3 + [1] * 15 + [600]])
def test_manifest_against_a_plain_tree(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(i, None if g == 2 else f"s{'é' if g % 2 else 'z'}{g}", rng.choice(["x", "", None, "long text"])) for g, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    assert got_manifest(spark, rows) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None), (None, "a", "x"), (None, "a", "y"), (4, "a", "x"), (4, "a", "x"), (4, "a", "w" * 100_000), (-3, "", ""), (5, "", "-")]
    assert got_manifest(spark, rows) == plain_manifest(rows)
    assert merkle.merkle_manifest(spark.createDataFrame([], KIND), ["doc_id", "text"]).count() == 0


def test_proofs_tell_changed_rows(spark):
    docs = spark.createDataFrame([(i, "s", f"Text {i}", "", 0) for i in range(40)], KIND)
    changed = merkle.leaf_digest([F.col("doc_id"), F.lower("text")])
    rows = merkle.merkle_manifest(docs.withColumn("changed", changed), ["doc_id", "text"], keep=("changed",))
    assert rows.where(merkle.folded(F.col("changed"), F.col("proof")) == F.col("root")).count() == 0
