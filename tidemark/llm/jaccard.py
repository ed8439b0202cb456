"""N-gram Jaccard join by token groups.

Documents become sets of word shingles. Sets that may be similar are brought
into bounded groups, each group's token union is kept as one row of a
token-group matrix, a document's overlap with that union bounds its overlap
with every member, and only groups whose bound reaches the threshold are
opened and compared exactly.

Finding what may be similar. Two sets of n and m tokens with similarity
``percent``/100 differ in at most d = (n + m)(100 - percent)/(100 + percent)
tokens. The token space of a size band is cut into more than d parts by hash
range; sets that similar then agree on all tokens of some part, so a hash of
each part's tokens is shuffled instead of the tokens (about a sixth as many
rows at 90 %). A set needs only its d + 1 rarest parts, in one order for all
sets (by how many sets share a part, then by key): the first part in that order
on which two similar sets agree is among those of both. So the parts of common
passages are spared, and no link is lost.

Hot parts. Where a needed part is shared by more than HOT sets, it is set aside,
and the sets that need it are cut again, into single tokens. Of those, only the
rarest count: at least ``percent``/100 of a set's tokens are in any set like it, so
the others are too few without one of the first ``n - percent * n / 100 + 1``; and
of two such sets the smaller has a common token among still fewer, its index. If
the first part that two similar sets share is set aside, both are cut again, so
no link is lost; and passages that many sets share fall out, as they aren't rare.
HOT lies above the few versions that a text has at any size of the corpus and
below the groups that grow with it, so the share of sets cut again stays the same.

Hot groups. Exact copies count once. A set's leader is the least of the sets that
have the most common of its keys, so the sets of a key meet in few blocks. Small connected components of candidates are blocks; larger
ones fall apart by leader, and a leader's sets by hash, into blocks of at most
BLOCK sets. Blocks are solved alone; then the leaders of the classes of one
candidate leader are; last, classes of different blocks that share a part are
compared, the sets of the smaller class with the blocks of the larger one.
No task gets more than a block and as many sets that ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import star_components
from tidemark.llm.grouped import by_group
from tidemark.llm.scratch import written, written_with
from tidemark.llm.textkit import mix, shingle_set, word_hashes

BLOCK = 400  # sets in a task's block
BLOCK_TOKENS = 1_000_000  # tokens in a task's block, if it has more than one set
SPARES = 1 << 16  # most parts that a set is counted to spare
MARGIN = 15  # percent of parts beyond those needed, so that the most common ones can be spared
HOT = 8  # most sets that share a part and are compared for it; if more do, they are cut into single tokens
TASK_SETS = 500  # sets solved by a task, on average at most; the work is in Python, so their bytes say little
SENT_IDS = 1_000_000  # ids sent to every task (16 MB); beyond that they are joined by a shuffle
SLICE = 256  # documents hashed together
_U = np.uint64


def _bands(percent: int, top: int) -> list[tuple[int, int, int]]:
    """(lowest size, parts, most parts that can differ) of each size band; bands grow by half."""
    out, low = [], 1
    while low <= top:
        high = max(low + 1, -(-low * 3 // 2)) if out else max(2, 100 // (100 - percent))
        differ = 2 * (high - 1) * (100 - percent) // (100 + percent)
        out.append((low, differ + 1 + -(-(differ + 1) * MARGIN // 100) if differ else 1, differ))
        low = high
    return out


def part_keys(tokens: np.ndarray, percent: int, bands: list[tuple[int, int, int]]) -> list[dict]:
    """For each band that the set belongs to or borders on: the keys of its parts and how many it can spare."""
    n, out = len(tokens), []
    for i, (low, parts, differ) in enumerate(bands):
        own = low <= n and (i + 1 == len(bands) or n < bands[i + 1][0])
        if not differ or not (own or n < low and 100 * n >= percent * low):
            continue
        part = ((tokens >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)  # rises with the token
        first = np.flatnonzero(np.diff(part, prepend=-1))
        sums = np.add.reduceat(mix(tokens ^ _U(0x2545F4914F6CDD1D)), first)
        salt = _U(i * 0x9E3779B97F4A7C55 % 2**64)
        keys = mix(sums + mix(part[first].astype(_U) + salt))
        spare = len(first) - (differ + 1)
        if spare < 0:  # too few parts with tokens: agreeing on an empty part counts, too
            empty = np.setdiff1d(np.arange(parts), part[first]).astype(_U)
            keys = np.concatenate((keys, mix(empty + salt + _U(0x5851F42D4C957F2D))))
        out.append({"band": i, "spare": int(spare), "keys": keys.view(np.int64)})
    return out


def digest(tokens: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return np.array([mix(tokens).sum(dtype=_U), mix(tokens ^ _U(0xA0761D6478BD642F)).sum(dtype=_U)], _U).tobytes()


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = _bands(percent, 1 << 40)
        kind = pa.list_(pa.struct([("band", pa.int32()), ("spare", pa.int32()), ("keys", pa.list_(pa.int64()))]))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = [shingle_set(h, width) for h in word_hashes(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([part_keys(s, percent, bands) for s in sets], kind)],
                    names=["id", "text_hash", "n", "node", "bands"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, f"id {id_type}, text_hash bigint, n bigint, node binary, bands array<struct<band:int,spare:int,keys:array<bigint>>>")


class TokenGroups:
    """The token-group matrix of some sets: which tokens occur in which group of similar sets."""

    def __init__(self, sets: list[np.ndarray], size: int = 16):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]) if len(sets[i]) else 0, len(sets[i])))
        self.groups = [np.array(order[i : i + size]) for i in range(0, len(order), size)]
        self.sizes = np.array([len(s) for s in sets])

    def links(self, queries: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each opened group: the queries and members that are similar enough, as index arrays."""
        n = np.array([len(q) for q in queries])
        both = [*queries, *self.sets]
        columns, at, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(both)), [len(s) for s in both])
        shared = count >= 2
        new = np.cumsum(shared) - 1
        keep = shared[at]
        row, at = row[keep], new[at[keep]]
        group = np.zeros(len(both), np.int64)
        for g, members in enumerate(self.groups):
            group[len(queries) + members] = g
        bound = np.zeros((len(queries), len(self.groups)), np.float32)
        overlap = {g: np.zeros((len(queries), len(m)), np.float32) for g, m in enumerate(self.groups)}
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        used = int(at[-1]) + 1 if len(at) else 0
        width = max(1, min(used, max(256, 4_000_000 // len(both))))  # columns multiplied at a time
        spans = [(lo, *np.searchsorted(at, (lo, lo + width))) for lo in range(0, used, width)]
        for lo, i, j in spans:
            r, c = row[i:j], at[i:j] - lo
            q = r < len(queries)
            x = np.zeros((len(queries), width), np.float32)
            x[r[q], c[q]] = 1
            union = np.zeros((len(self.groups), width), np.float32)
            union[group[r[~q]], c[~q]] = 1
            bound += x @ union.T
        need = -(-percent * n // 100)
        opened = {g: np.flatnonzero((bound[:, g] >= need) & (n > 0)) for g in range(len(self.groups))}
        for lo, i, j in spans:
            r, c = row[i:j], at[i:j] - lo
            x = np.zeros((len(both), width), np.float32)
            x[r, c] = 1
            for g, which in opened.items():
                if len(which):
                    overlap[g][which] += x[which] @ x[len(queries) + self.groups[g]].T
        for g, which in opened.items():
            if len(which):
                o = overlap[g][which].astype(np.int64)
                union = n[which][:, None] + self.sizes[self.groups[g]][None, :] - o
                a, b = np.nonzero((100 * o >= percent * union) & (union > 0))
                yield which[a], self.groups[g][b]


def _classes(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set, the first set that it is connected with."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for some, others in TokenGroups(sets).links(sets, percent):
        for i, j in zip(some.tolist(), others.tolist()):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
    return [find(i) for i in range(len(sets))]


def _token_sets(texts: list[str], width: int) -> list[np.ndarray]:
    return [shingle_set(h, width) for h in word_hashes(texts)]


def _solve_blocks(rows: DataFrame, count: int, width: int, percent: int) -> DataFrame:
    """rows: block, comp, node, text, and how many there are. The class of each node within its block, named by its first node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_group(batches, "block"):
            sets = _token_sets(g["text"], width)
            order = sorted(range(len(sets)), key=g["node"].__getitem__)
            first = _classes([sets[i] for i in order], percent)
            nodes = [g["node"][i] for i in order]
            yield pa.RecordBatch.from_arrays([pa.array([g["comp"][0]] * len(order), pa.int64()), pa.array(nodes, pa.binary()), pa.array([nodes[i] for i in first], pa.binary())], names=["comp", "node", "label"])

    sorted_rows = rows.select("block", "comp", "node", "text").repartition(count // TASK_SETS + 1, "block").sortWithinPartitions("block")
    return sorted_rows.mapInArrow(run, "comp bigint, node binary, label binary")


def _open_groups(rows: DataFrame, count: int, width: int, percent: int) -> DataFrame:
    """rows: task, label, text, query, and about how many there are. The labels of queries and members that a link joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_group(batches, "task"):
            asks = [i for i, q in enumerate(g["query"]) if q]
            has = [i for i, q in enumerate(g["query"]) if not q]
            if not asks or not has:
                continue
            sets = _token_sets(g["text"], width)
            found = set()
            for some, others in TokenGroups([sets[i] for i in has]).links([sets[i] for i in asks], percent):
                found |= {(g["label"][asks[i]], g["label"][has[j]]) for i, j in zip(some.tolist(), others.tolist())}
            found = [(a, b) for a, b in found if a != b]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    sorted_rows = rows.select("task", "label", "text", "query").repartition(count // TASK_SETS + 1, "task").sortWithinPartitions("task")
    return sorted_rows.mapInArrow(run, "a binary, b binary")


def _pieces(rows: DataFrame, per: list[str], sets: int, tokens: int) -> DataFrame:
    """Adds ``piece``, which stands for a group of at most about so many sets and tokens."""
    need = rows.groupBy(*per).agg(F.greatest(F.ceil(F.count("*") / sets), F.ceil(F.sum("n") / tokens)).cast("long").alias("pieces"))
    return rows.join(need, per).withColumn("piece", F.xxhash64(*per, F.pmod(F.xxhash64("node"), "pieces"))).drop("pieces")


def _into_blocks(rows: DataFrame) -> DataFrame:
    """rows: node, n, comp, leader and more. Adds ``block`` and whether the component is ``large``."""
    size = rows.groupBy("comp").agg(((F.count("*") > BLOCK) | (F.sum("n") > BLOCK_TOKENS)).alias("large"))
    rows = rows.join(size, "comp")
    apart = _pieces(rows.where("large"), ["comp", "leader"], BLOCK, BLOCK_TOKENS).withColumnRenamed("piece", "block")
    return rows.where("NOT large").withColumn("block", F.col("comp")).unionByName(apart)


def _once(sets: DataFrame) -> DataFrame:
    """One row of each set: those of exact copies but the one with the smallest id go."""
    first = sets.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies, seen = written_with(sets.select("node", "id").join(first, "node").where("id > first").select("node", "id").distinct(), "copies")
    copies = copies if seen["rows"] > SENT_IDS else F.broadcast(copies)
    return sets.join(copies, ["node", "id"], "left_anti")


def shared_parts(sets: DataFrame) -> DataFrame:
    """(key, a, b, sets): the parts that each set needs and shares, with the least set that has the part and how many do; a and b are 64-bit hashes of node."""
    nodes = _once(sets).select(F.xxhash64("node").alias("a"), F.explode("bands").alias("x"))
    spare = F.greatest(F.lit(0), F.least(F.col("x.spare"), F.lit(SPARES - 1)))
    parts = nodes.select("a", (F.col("x.band") * SPARES + spare).alias("band"), F.explode("x.keys").alias("key"))
    same = Window.partitionBy("key")
    shared = parts.withColumn("b", F.min("a").over(same)).withColumn("top", F.max("a").over(same)).withColumn("sets", F.count("*").over(same)).where("b < top")
    most_common_first = Window.partitionBy("a", "band").orderBy(F.col("sets").desc(), F.col("key").desc())
    return shared.withColumn("__rank", F.row_number().over(most_common_first)).where(F.col("__rank") > F.pmod("band", F.lit(SPARES))).select("key", "a", "b", "sets").distinct()


def rare_tokens(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, a, b, sets) from (a, n, text): the rarest tokens of each set, where some set has them in its index; b is the least set that has the key, ``sets`` how many have the token.

    Tokens are counted before the shuffle and the counts joined back, so that a
    token that most sets have is no one's task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = _token_sets(part.column(2).to_pylist(), width)
                row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                token = np.concatenate(sets).view(np.int64) if len(row) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(token)], names=["a", "n", "token"])

    tokens = written(texts.select("a", "n", "text").mapInArrow(run, "a bigint, n bigint, token bigint"), "tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    most_common_first = Window.partitionBy("a").orderBy(F.col("sets").desc(), F.col("token").desc())
    ranked = tokens.join(counts, "token").withColumn("__rank", F.row_number().over(most_common_first))
    probe, index = F.ceil(F.col("n") * percent / 100), F.ceil(F.col("n") * (2 * percent) / (100 + percent))
    rare = written(ranked.where(F.col("__rank") >= probe).select("token", "a", "sets", (F.col("__rank") >= index).alias("index")), "rare")
    live = rare.groupBy("token").agg(F.min("a").alias("b"), F.max("a").alias("top"), F.max("index").alias("index")).where("index AND b < top").select("token", "b")
    return rare.drop("index").join(live, "token").select(F.xxhash64(F.lit("token"), "token").alias("key"), "a", "b", "sets").distinct()


def _texts_of(docs: DataFrame, id_col: str, text_col: str, chosen: DataFrame, count: int, repeated: bool) -> DataFrame:
    """The ``count`` rows of ``chosen`` (id, text_hash, node and more, written) with their text; once each, even if rows are ``repeated``."""
    chosen = chosen if count > SENT_IDS else F.broadcast(chosen)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    found = rows.join(chosen, rows["id"].eqNullSafe(chosen["id"]) & (rows["text_hash"] == chosen["text_hash"])).select(*chosen.drop("id", "text_hash").columns, "text")
    return found.dropDuplicates(["node"]) if repeated else found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """Classes of documents connected by Jaccard similarity of at least ``percent``/100 of their word shingles.

    Returns one row per input row: ``id_col``, n_shingles (size of its set) and
    component_id (the smallest id that it reaches by links, its own included).
    Words are runs of non-space bytes with A-Z lower-cased; a text of fewer than
    ``width`` words is one shingle; a null, empty or blank text has none and is
    linked with nothing. Equal sets are linked. Repeated rows and rows of one id
    with several texts are rows of their own; a null id is never the smallest
    but is kept. Other columns are ignored, so their names cannot clash. An
    empty table gives an empty result.
    """
    sets = written(_sets(docs, id_col, text_col, width, percent), "sets")
    one = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash"))
    nodes = sets.where("n > 0").groupBy("node", "n").agg(one.alias("one")).select("node", "n", "one.id", "one.text_hash", F.xxhash64("node").alias("a"))
    repeated = not sets.groupBy("node", "id", "text_hash").count().where("count > 1").isEmpty()
    parts = written(shared_parts(sets.where("n > 0")), "parts")
    hot, seen = written_with(nodes.join(parts.where(F.col("sets") > HOT).select("a").distinct(), "a"), "hot")
    if seen["rows"]:
        again = rare_tokens(_texts_of(docs, id_col, text_col, hot, seen["rows"], repeated), width, percent)
        parts = written(parts.where(F.col("sets") <= HOT).unionByName(again), "parts")
    comps = star_components(parts, "a", "b").select(F.col("node").alias("a"), F.col("root").alias("comp"))
    leaders = parts.groupBy("a").agg(F.max(F.struct("sets", "b")).getField("b").alias("leader"))
    chosen, seen = written_with(_into_blocks(nodes.join(comps, "a").join(leaders, "a")), "chosen", large=F.count(F.when(F.col("large"), 1)))
    texts = written(_texts_of(docs, id_col, text_col, chosen, seen["rows"], repeated), "texts")
    labels = written(_solve_blocks(texts, seen["rows"], width, percent), "labels")
    if seen["large"]:
        labels = _join_blocks(labels, texts.where("large"), seen["large"], parts, width, percent)
    named = nodes.select("node", "id").join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of_node = named.join(least, "label").select("node", "component_id")
    return sets.drop("bands").join(of_node, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining classes that ``links`` (a, b) connects."""
    roots = star_components(links, "a", "b").select(F.col("node").alias("label"), "root")
    return written(labels.join(roots, "label", "left").select("comp", "node", F.coalesce("root", "label").alias("label")), "labels")


def _larger_elsewhere(asking: DataFrame, there: DataFrame) -> DataFrame:
    """(a, block): other blocks where a key of the set ``a`` is in a larger class; both sides are key, a, block, label and size.

    A block's largest class of a key stands for all, so a key gives a row for each set and block at most, not for each set and class.
    """
    largest = there.groupBy("key", F.col("block").alias("other")).agg(F.max(F.struct("size", "label")).alias("largest"))
    larger = (F.col("block") != F.col("other")) & (F.col("largest") > F.struct("size", "label"))
    return asking.join(largest, "key").where(larger).select("a", F.col("other").alias("block"))


def _join_blocks(labels: DataFrame, large: DataFrame, count: int, parts: DataFrame, width: int, percent: int) -> DataFrame:
    """Joins classes of different blocks of one candidate component; ``large`` has ``count`` rows.

    The largest class of a component asks no one, so a component of one class,
    as most are by then, costs nothing, and in others only the keys of sets
    outside the largest class are looked up.
    """
    heads = large.join(labels.where("node = label").select("node"), "node", "left_semi").drop("block")
    found = _solve_blocks(_pieces(heads, ["comp", "leader"], BLOCK, BLOCK_TOKENS).withColumnRenamed("piece", "block"), count, width, percent)
    labels = _relabel(labels, found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    sizes = labels.groupBy("comp", "label").agg(F.count("*").alias("size"))
    top = sizes.groupBy("comp").agg(F.max(F.struct("size", "label")).getField("label").alias("top"))
    sizes = sizes.join(top, "comp").select("label", "size", (F.col("label") != F.col("top")).alias("asks"))
    members = written(large.select("a", "node", "n", "block", "text").join(labels.select("node", "label").join(sizes, "label"), "node"), "members")
    asking = written(parts.select("key", "a").join(members.where("asks").select("a", "block", "label", "size"), "a"), "asking")
    there = parts.select("key", "a").join(asking.select("key").distinct(), "key").join(members.select("a", "block", "label", "size"), "a")
    pairs = _larger_elsewhere(asking, there).distinct()
    asks = members.select("a", "node", "n", "label", "text").join(pairs, "a")
    asks, seen = written_with(_pieces(asks, ["block"], BLOCK, BLOCK_TOKENS).select("piece", "block", "label", "text"), "asks")
    tasks = asks.select("block", "piece").distinct()
    queries = asks.select(F.col("piece").alias("task"), "label", "text", F.lit(True).alias("query"))
    groups = members.join(tasks, "block").select(F.col("piece").alias("task"), "label", "text", F.lit(False).alias("query"))
    return _relabel(labels, _open_groups(queries.unionByName(groups), 2 * seen["rows"], width, percent))
