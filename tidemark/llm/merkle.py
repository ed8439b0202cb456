"""Merkle dataset manifest: each row's digest, its proof, and the root over all groups.

Leaves are cut into aligned blocks of ``FANOUT ** LEVELS``, each hashed in one
place. Above the blocks it is a butterfly exchange: in a round, a block swaps
the digest of its node with one block of each sibling node (that of its own
lane, the place within the node), and every lane hashes the same parent. So
after the last round each block has the digests beside its whole path, and no
pass from the root downwards is needed. A node with fewer blocks than lanes
sends copies of its digest to the lanes that it lacks. The subroots of the
groups go on in the same way, with all blocks of a group as its lanes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import small_batches, written
from tidemark.operators.scan import numbered, parted, scan

FANOUT = 16
LEVELS = 2  # of the tree within a block
ROWS = 256  # rows that are sent on at a time
PROOF = "array<struct<left:string,right:string>>"


def leaf_digest(values: list[Column]) -> Column:
    """Lowercase hex digest of a row: each value's byte count and bytes, ``-`` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def proof_digest(proof: Column) -> Column:
    """The digest of all digests of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), "").cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]).cast("binary"), 256))


def _hash(run: list[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def _levels(leaves: list[str], whole: bool) -> list[list[str]]:
    """Nodes from the leaves up to a block's root; a block that is its group's only one stops at a single node."""
    levels = [leaves]
    while len(levels[-1]) > 1 or (not whole and len(levels) <= LEVELS):
        now = levels[-1]
        levels.append([_hash(now[i : i + FANOUT]) for i in range(0, len(now), FANOUT)])
    return levels


def _digests(column: pa.Array, row: int) -> list[str]:
    return [x.hex() for x in column[row].values.to_pylist()]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root of each block."""
    for batch in batches:
        whole = batch.column("blocks").to_pylist()
        roots = [_levels(_digests(batch.column("leaves"), n), whole[n] == 1)[-1][0] for n in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grp", "block", "blocks")), pa.array(roots, pa.string())], ["grp", "block", "blocks", "node"])


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each leaf: its path within the block, then what the block got in the exchange."""
    for batch in batches:
        for n in range(batch.num_rows):
            leaves = _digests(batch.column("leaves"), n)
            levels = _levels(leaves, batch.column("blocks")[n].as_py() == 1)[:-1]
            beside = []  # for each level, the (left, right) of each of its nodes
            for now in levels:
                runs = [now[i : i + FANOUT] for i in range(0, len(now), FANOUT)]
                beside.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
            above = [(x["left"], x["right"]) for x in batch.column("above")[n].as_py()]
            rows, depth = batch.column("rows")[n].values, len(beside) + len(above)
            for at in range(0, len(leaves), ROWS):
                some = range(at, min(at + ROWS, len(leaves)))
                pairs = [p for i in some for p in [*(side[i // FANOUT**k] for k, side in enumerate(beside)), *above]]
                struct = pa.StructArray.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], ["left", "right"])
                proofs = pa.ListArray.from_arrays(pa.array(range(0, depth * len(some) + 1, depth) if depth else [0] * (len(some) + 1), pa.int32()), struct)
                fixed = [pa.array([batch.column(c)[n].as_py()] * len(some), pa.string()) for c in ("subroot", "root")]
                yield pa.RecordBatch.from_arrays([rows.slice(at, len(some)), pa.array([leaves[i] for i in some], pa.string()), *fixed, proofs], ["row", "leaf", "subroot", "root", "proof"])


def _exchange(rows: DataFrame, parent: list[str]) -> DataFrame:
    """One round: nodes with the same ``parent`` swap their digests lane by lane.

    rows: parent columns; digit (place among the siblings); lane and lanes (of the
    node); most (lanes of the largest sibling); node; above.
    """
    kept = [c for c in rows.columns if c not in (*parent, "digit", "node", "above", "most", "lane", "lanes")]
    own = F.struct(*kept, "above")
    sent = rows.select(*parent, "digit", "node", own.alias("own"), "lane", F.explode(F.sequence("lane", F.col("most") - 1, "lanes")).alias("to"))
    sent = sent.withColumn("own", F.when(F.col("lane") == F.col("to"), F.col("own")))  # copies to lanes that the node lacks have no block
    met = sent.groupBy(*parent, F.col("to").alias("lane")).agg(F.array_sort(F.collect_list(F.struct("digit", "node", "own"))).alias("met"))  # at most FANOUT
    nodes = lambda x: F.array_join(F.transform(x, lambda y: y["node"]), "")
    met = met.withColumn("parent_node", F.sha2(nodes(F.col("met")).cast("binary"), 256)).select("*", F.explode("met").alias("x")).where("x.own IS NOT NULL")
    left = nodes(F.filter("met", lambda y: y["digit"] < F.col("x.digit")))
    right = nodes(F.filter("met", lambda y: y["digit"] > F.col("x.digit")))
    above = F.concat(F.col("x.own.above"), F.array(F.struct(left.alias("left"), right.alias("right"))))
    return met.select(*[F.col(f"x.own.{c}").alias(c) for c in kept], F.col("parent_node").alias("node"), above.alias("above"))


def _butterfly(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """blocks: grp, block, blocks (of its group), node. Adds subroot, root and above, the proof over the blocks.

    groups: a row for each group, with its place and the number of its blocks.
    The rounds follow from the largest group and the number of groups.
    """
    largest, many = groups.agg(F.max("blocks"), F.count("*")).first()
    rows, width = blocks.withColumn("above", F.array().cast(PROOF)), 1
    while width < (largest or 0):
        node = F.floor(F.col("block") / width)
        again = F.col("blocks") > width  # more than one node is left
        begin = node * width
        placed = rows.where(again).withColumns({
            "digit": node % FANOUT, "up": F.floor(node / FANOUT), "lane": F.col("block") - begin, "lanes": F.least(F.lit(width), F.col("blocks") - begin),
            "most": F.least(F.lit(width), F.col("blocks") - F.floor(node / FANOUT) * (width * FANOUT)),
        })
        rows = rows.where(~again).unionByName(_exchange(placed.withColumn("of", F.col("grp")), ["of", "up"]))
        width *= FANOUT
    rows, width = rows.withColumn("subroot", F.col("node")), 1
    if many > 1:
        rows = rows.join(groups.select("grp", "place", "before"), "grp")
    while width < many:
        node = F.floor(F.col("place") / width).alias("up")
        sizes = groups.groupBy(node).agg(F.min("before").alias("begin"), F.sum("blocks").alias("lanes"))
        most = sizes.groupBy(F.floor(F.col("up") / FANOUT).alias("up2")).agg(F.max("lanes").alias("most"))
        sizes = sizes.withColumn("up2", F.floor(F.col("up") / FANOUT)).join(most, "up2")
        placed = rows.withColumn("up", F.floor(F.col("place") / width)).join(sizes, "up")
        placed = placed.withColumns({"digit": F.col("up") % FANOUT, "lane": F.col("before") + F.col("block") - F.col("begin")}).drop("up", "begin")
        rows = _exchange(placed, ["up2"])
        width *= FANOUT
    return rows.select("grp", "block", "subroot", F.col("node").alias("root"), "above")


def merkle_manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: its id, leaf, subroot, root, proof, and the ``keep`` columns.

    A leaf is the digest of ``columns``. In each group (null is one) leaves ascend
    by id, null first, rows of one id by their leaf; while several nodes remain,
    every 16 consecutive ones become the digest of their hex digests, the last
    run with what it has. What remains is the group's subroot; the subroots of
    the groups, null first and by their bytes, give the root alike. ``proof``
    lists, for each level up to the root, the siblings' digests to the left and
    to the right. Repeated rows are leaves each; an empty table has no rows and
    no root. Equal rows may change places, which changes none of their values
    but the proof. ``keep`` columns must be of types that can be sorted.
    """
    small_batches(docs.sparkSession)
    kept = F.struct(F.col(id_col), *keep)
    named = docs.select(F.coalesce(F.concat(F.lit("v"), F.col(group_col).cast("string")), F.lit("")).alias("grp"), F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in columns]).alias("leaf"), kept.alias("row"))
    placed = numbered(named, ["grp"], ["id", "leaf"])
    size = FANOUT**LEVELS
    entry = F.struct("place", F.unhex("leaf").alias("leaf"), "row")
    cut = placed.groupBy("grp", F.floor(F.col("place") / size).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # at most `size`
    cut = written(cut.select("grp", "block", F.col("entries.leaf").alias("leaves"), F.col("entries.row").alias("rows")), "blocks")
    counts = cut.groupBy("grp").agg(F.count("*").alias("blocks"))
    groups = scan(parted(counts, [], ["grp"]), [], ["grp"], running={"place": F.lit(1).cast("long"), "before": F.col("blocks")})  # in the order of UTF-8 bytes
    groups = written(groups.select("grp", "blocks", (F.col("place") - 1).alias("place"), (F.col("before") - F.col("blocks")).alias("before")), "groups")
    sized = cut.join(groups.select("grp", "blocks"), "grp")
    roots = sized.select("grp", "block", "blocks", "leaves").mapInArrow(_roots, "grp string, block long, blocks long, node string")
    above = _butterfly(written(roots, "roots"), groups)
    kind = docs.select(kept.alias("row")).schema["row"].dataType.simpleString()
    out = sized.join(above, ["grp", "block"]).select("blocks", "leaves", "rows", "subroot", "root", "above").mapInArrow(_proved, f"row {kind}, leaf string, subroot string, root string, proof {PROOF}")
    return out.select("row.*", "leaf", "subroot", "root", "proof")
