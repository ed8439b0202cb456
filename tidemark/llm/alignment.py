"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often in the corpus.

Both sides cut texts at blanks, so each distinct word is aligned once and texts
are put together from their words.

External counting of (pair, document) records. Tasks that tokenise write
zstd-compressed runs, sorted by side A's id and cut by its radix. Each radix's
runs are merged from a heap of their heads, which counts the documents of each
pair; as the order is A-major, the highest count of an A id is known when its
pairs end. The counts then meet the same runs again, and every run gets back
one contribution per document, not one per record. A radix with many bytes of
runs (a hot id) is sliced by run; slices are counted apart and merged.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.scratch import written

RADIX = 64  # parts of side A's vocabulary
RUN = 1_000_000  # records in a run
SLICE_BYTES = 16 << 20  # compressed bytes of runs that one task gets
BLOCK_TOKENS = 400_000  # tokens of whole texts that are aligned at a time
LINKS = 4_000_000  # links that are held at a time
WORDS = 1_000_000  # words of texts that are looked up at a time
WIDE = 1 << 12  # links of a group from which its repeated ids are counted first
CHUNK = 1 << 14  # keys of a run that are merged at a time
KEPT = 400_000  # words that a worker keeps, and eighth of the pairs; then it begins anew
DOC_BITS, ID_BITS = 22, 21  # a record is A id, B id and document in 64 bits
PIECE_SPACE = "▁"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin characters for themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


UNSURE = re.compile(r"[^\w!-~ ] ")  # a blank after a character that may be white space too
BLANKS = re.compile(r" +[^ ]*")


def blank_words(text: str) -> list[str]:
    """Cuts a text that begins with a blank where blanks follow what is surely no white space.

    A byte-level pattern of letters, numbers, others and white space always cuts
    there, and so do pieces none of which goes on with a blank.
    """
    words = BLANKS.findall(text)
    if not UNSURE.search(text):
        return words
    out: list[str] = []
    for w in words:
        if out and UNSURE.search(out[-1][-1] + " "):
            out[-1] += w
        else:
            out.append(w)
    return out


Ask = Callable[[list[str]], list[list[int]]]


def byte_level(path: str) -> tuple[Ask, list[bytes]]:
    """Side A: what encodes words, and the bytes of each entry of a byte-level vocabulary file. Strings of special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and not spec["normalizer"]
    if not plain:
        raise ValueError("side A must be byte-level, without a normaliser or prefix")
    alphabet = _byte_alphabet()
    entries = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for entry, i in spec["model"]["vocab"].items():
        entries[i] = bytes(map(alphabet.__getitem__, entry))
    return lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)], entries


def piece_level(path: str) -> tuple[Ask, list[bytes]]:
    """Side B: the same of a SentencePiece model that adds a blank in front; the first blank of a word is that one."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(PIECE_SPACE in p.lstrip(PIECE_SPACE) for p in pieces):
        raise ValueError("side B must have no piece that goes on with a blank")
    entries = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(PIECE_SPACE, " ").encode() for i, p in enumerate(pieces)]
    blank = model.encode("a ")[1:]  # the added blank alone

    def ask(words: list[str]) -> list[list[int]]:
        return [ids or blank for ids in model.encode([w[1:] for w in words], num_threads=1)]

    return ask, entries


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.astype("<u8" if a.dtype.itemsize == 8 else "<u4").tobytes() for a in arrays))


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, np.int64, len(kinds) + 1)[1:]
    out, at = [], 8 * (len(kinds) + 1)
    for kind, n in zip(kinds, sizes):
        out.append(np.frombuffer(data, kind, int(n), at))
        at += out[-1].nbytes
    return out


def _radix_first(ids: np.ndarray) -> np.ndarray:
    """A one-to-one renumbering of A ids by which each radix's ids follow one another."""
    return (ids % RADIX) << 15 | ids // RADIX


class _Runs:
    """Records of a task's texts, sorted and cut into runs."""

    def __init__(self, task: int):
        self.task, self.number = task, 0
        self.rows: list[dict] = []
        self._begin()

    def _begin(self) -> None:
        self.records: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held = self.docs = 0

    @property
    def name(self) -> int:
        return self.task << 24 | self.number

    def add(self, records: np.ndarray, times: np.ndarray) -> None:
        self.records.append(records)
        self.times.append(times)
        self.held += len(records)

    def close(self) -> None:
        """Emits the run, one row for each radix that it has."""
        if self.held:
            records, times = np.concatenate(self.records), np.concatenate(self.times)
            order = np.argsort(records, kind="stable")
            records, times = records[order], times[order]
            keys, docs = records >> np.uint64(DOC_BITS), (records & np.uint64((1 << DOC_BITS) - 1)).astype(np.uint32)
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            names, sizes = keys[first], np.diff(np.r_[first, len(keys)]).astype(np.uint32)
            radix = (names >> np.uint64(ID_BITS + 15)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, radix[1:] != radix[:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                a, b = first[lo], first[hi] if hi < len(first) else len(keys)
                gaps = np.diff(names[lo:hi], prepend=np.uint64(0))
                self.rows.append({"run": self.name, "radix": int(radix[lo]), "keys": _packed(gaps, sizes[lo:hi]), "docs": _packed(docs[a:b], times[a:b].astype(np.uint32))})
        self.number += 1
        self._begin()


def _expanded(ga: np.ndarray, gb: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Every A token with every B token of its group (both sorted by group): indexes of A, indexes of B."""
    n_b = np.bincount(gb, minlength=groups)
    start = np.cumsum(n_b) - n_b
    times = n_b[ga]
    left = np.repeat(np.arange(len(ga)), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[ga], times)
    return left, right


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) and how often each is there."""
    both, n = np.unique(group << 32 | ids, return_counts=True)
    return both >> 32, both & (1 << 32) - 1, n


def _records(doc_of_group: np.ndarray, ga: np.ndarray, gb: np.ndarray, a: np.ndarray, b: np.ndarray, first_doc: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (pair, document) records and the links of each, some A ids at a time."""
    groups = len(doc_of_group)
    links = np.bincount(ga, minlength=groups) * np.bincount(gb, minlength=groups)
    wa, wb = np.ones(len(ga), np.int64), np.ones(len(gb), np.int64)
    if len(links) and links.max() > WIDE:
        (ga, a, wa), (gb, b, wb) = _counted(ga, a), _counted(gb, b)
        links = np.bincount(ga, minlength=groups) * np.bincount(gb, minlength=groups)
    parts = int(links.sum() // LINKS) + 1
    for part in range(parts):
        of = slice(None) if parts == 1 else np.flatnonzero(a % parts == part)
        g, ids, w = ga[of], a[of], wa[of]
        left, right = _expanded(g, gb, groups)
        keys = (_radix_first(ids)[left] << ID_BITS | b[right]) << DOC_BITS | doc_of_group[g][left] + first_doc
        order = np.argsort(keys.astype(np.uint64), kind="stable")
        keys, times = keys.astype(np.uint64)[order], (w[left] * wb[right])[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)]
        yield keys[first], np.add.reduceat(times, first) if len(first) else times


def _aligned(ids_a: list[list[int]], ids_b: list[list[int]], length_a: np.ndarray, length_b: np.ndarray) -> dict[str, np.ndarray]:
    """Groups of some texts; token lists that do not spell the same bytes on both sides must be empty."""
    a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
    doc_a, doc_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (ids_a, ids_b))
    end_a, end_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
    cut_a, cut_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
    ga, gb = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    return {"a": a, "b": b, "doc_a": doc_a, "doc_b": doc_b, "ga": ga, "gb": gb, "doc": doc_a[cut_a], "cut_a": cut_a, "cut_b": cut_b}


def _spelled(x: dict[str, np.ndarray], docs: int, texts: tuple[list[str], list[str]]) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each text. texts: each id followed by a comma, then each followed by a bar (A) or semicolon (B)."""
    kinds = [len(t) // 2 for t in texts]
    before_b = np.searchsorted(x["gb"], x["ga"], "left")  # B tokens of earlier groups come before an A token
    before_a = np.searchsorted(x["ga"], x["gb"], "right")
    place_a, place_b = np.arange(len(before_b)) + before_b, np.arange(len(before_a)) + before_a
    words = np.empty(len(place_a) + len(place_b), np.int64)
    words[place_a] = x["a"] + np.where(x["cut_a"], kinds[0], 0)
    words[place_b] = x["b"] + np.where(x["cut_b"], kinds[1], 0) + len(texts[0])
    every = texts[0] + texts[1]
    sizes = np.bincount(x["doc_a"], minlength=docs) + np.bincount(x["doc_b"], minlength=docs)
    ends = np.cumsum(sizes)
    listed = words.tolist()
    return ["".join(map(every.__getitem__, listed[e - n : e]))[:-1] for e, n in zip(ends.tolist(), sizes.tolist())]


DIGEST = "run long, doc int, id {id}, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, radix int, keys binary, docs binary"


class _Aligned:
    """Words as both sides cut them: tokens, groups and pairs of each are found once, and texts put together from them.

    Words are kept until ``KEPT`` of them (or eight times as many pairs) are
    there; then it begins anew.
    """

    COUNTS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, model_a: str, model_b: str):
        (self.ask_a, bytes_a), (self.ask_b, bytes_b) = byte_level(model_a), piece_level(model_b)
        if max(len(bytes_a) // RADIX >> 15, len(bytes_b) >> ID_BITS):
            raise ValueError("vocabularies of at most 2,097,152 entries")
        self.bytes_a, self.bytes_b = bytes_a, bytes_b
        self.length_a, self.length_b = (np.array([max(len(x), 1) for x in e]) for e in (bytes_a, bytes_b))
        self.spelling = [f"{i}," for i in range(len(bytes_a))] + [f"{i}|" for i in range(len(bytes_a))], [f"{i}," for i in range(len(bytes_b))] + [f"{i};" for i in range(len(bytes_b))]
        self._begin()

    def _begin(self) -> None:
        self.place: dict[str, int] = {}
        self.spelled: list[str] = []
        self.counts = {c: np.zeros(0, np.int64) for c in self.COUNTS}
        self.bad = np.zeros(0, bool)  # words that a side does not spell
        self.start, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids_a, ids_b = self.ask_a(words), self.ask_b(words)
        entry_a, entry_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        bad = np.array([not b"".join(map(entry_a, a)) == w.encode() == b"".join(map(entry_b, b)) for w, a, b in zip(words, ids_a, ids_b)])
        for n in np.flatnonzero(bad):
            ids_a[n], ids_b[n] = [], []
        x = _aligned(ids_a, ids_b, self.length_a, self.length_b)
        links = np.bincount(x["ga"], minlength=len(x["doc"])) * np.bincount(x["gb"], minlength=len(x["doc"]))
        count = lambda d: np.bincount(d, minlength=len(words))
        n_links = np.zeros(len(words), np.int64)
        np.add.at(n_links, x["doc"], links)
        found = list(_records(x["doc"], x["ga"], x["gb"], x["a"], x["b"], 0))
        records, times = (np.concatenate([f[k].astype(np.int64) for f in found]) for k in (0, 1))
        word = records & (1 << DOC_BITS) - 1
        order = np.argsort(word, kind="stable")
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.spelled += _spelled(x, len(words), self.spelling)
        for c, values in zip(self.COUNTS, (count(x["doc_a"]), count(x["doc_b"]), count(x["doc"]), n_links)):
            self.counts[c] = np.concatenate([self.counts[c], values])
        self.bad = np.concatenate([self.bad, bad])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(count(word))])
        self.pairs, self.times = np.concatenate([self.pairs, records[order] >> DOC_BITS]), np.concatenate([self.times, times[order]])

    def texts(self, texts: list[str], runs: _Runs) -> tuple[dict[str, np.ndarray], list[str]]:
        """Counts of each text and its groups; its records go to ``runs``."""
        words = [blank_words(" " + t) if t and PIECE_SPACE not in t else [] for t in texts]
        if len(self.place) > KEPT or len(self.pairs) > 8 * KEPT:
            self._begin()
        lacking = list(set().union(*words) - self.place.keys())
        for at in range(0, len(lacking), 1 << DOC_BITS - 2):
            self._learn(lacking[at : at + (1 << DOC_BITS - 2)])
        sizes = np.array([len(w) for w in words])
        flat = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        bad = np.bincount(doc, self.bad[flat], len(texts)) > 0
        counts = {c: np.where(bad, 0, np.bincount(doc, v[flat], len(texts)).astype(np.int64)) for c, v in self.counts.items()}
        ends, listed = np.cumsum(sizes).tolist(), flat.tolist()
        spelled = ["" if b else ";".join(map(self.spelled.__getitem__, listed[e - n : e])) for e, n, b in zip(ends, sizes.tolist(), bad.tolist())]
        good = ~bad[doc]
        self._records(flat[good], doc[good] + runs.docs, runs)
        return counts, spelled

    def _records(self, flat: np.ndarray, doc: np.ndarray, runs: _Runs) -> None:
        """Distinct (pair, document) records of all words, some pairs at a time where there are many."""
        each = self.start[flat + 1] - self.start[flat]
        parts = int(each.sum() // LINKS) + 1
        for part in range(parts):
            records, times = [], []
            for at in range(0, len(flat), WORDS):
                some, n = flat[at : at + WORDS], each[at : at + WORDS]
                where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[some], n)
                pairs = self.pairs[where]
                of = slice(None) if parts == 1 else np.flatnonzero(pairs % parts == part)
                records.append((pairs[of] << DOC_BITS | np.repeat(doc[at : at + WORDS], n)[of]).astype(np.uint64))
                times.append(self.times[where[of]])
            if records:
                records, times = np.concatenate(records), np.concatenate(times)
                order = np.argsort(records)
                records, times = records[order], times[order]
                first = np.flatnonzero(np.r_[True, records[1:] != records[:-1]])[: len(records)]
                runs.add(records[first], np.add.reduceat(times, first) if len(first) else times)


@lru_cache(maxsize=1)
def _aligner(model_a: str, model_b: str) -> _Aligned:
    """One for each Python worker."""
    return _Aligned(model_a, model_b)


def _tokenise(model_a: str, model_b: str, id_type: pa.DataType, keep_groups: bool) -> Callable:
    """For tasks: a row for each document, and after them the rows of runs."""
    longs = [(c, pa.int64()) for c in _Aligned.COUNTS]
    schema = pa.schema([("run", pa.int64()), ("doc", pa.int32()), ("id", id_type), *longs, ("groups", pa.string()), ("groups_sha256", pa.string()), ("radix", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])

    def rows_of(aligner: _Aligned, runs: _Runs, ids: list, texts: list[str]) -> pa.RecordBatch:
        counts, spelled = aligner.texts(texts, runs)
        none = [None] * len(texts)
        digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled]
        out = {"run": [runs.name] * len(texts), "doc": np.arange(runs.docs, runs.docs + len(texts)), "id": ids, **counts, "groups": spelled if keep_groups else none, "groups_sha256": digests, "radix": none, "keys": none, "docs": none}
        runs.docs += len(texts)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    def closed(runs: _Runs) -> Iterator[pa.RecordBatch]:
        runs.close()
        for at in range(0, len(runs.rows), 16):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in runs.rows[at : at + 16]], f.type) for f in schema], schema=schema)
        runs.rows.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, runs = _aligner(model_a, model_b), _Runs(TaskContext.get().partitionId())
        gc.disable()  # many kept words, no cycles: walking them again and again took a quarter of the time
        try:
            for batch in batches:
                ids, texts = batch.column("id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
                begin = size = 0
                for n, t in enumerate(texts):
                    size += len(t) // 3
                    if size > BLOCK_TOKENS or n + 1 == len(texts):
                        yield rows_of(aligner, runs, ids[begin : n + 1], texts[begin : n + 1])
                        begin, size = n + 1, 0
                        if runs.held >= RUN or runs.docs >= 1 << DOC_BITS - 1:
                            yield from closed(runs)
            yield from closed(runs)
        finally:
            gc.enable()

    return run


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (keys, counts) of all runs, counts of equal keys added, from a heap of the runs' heads, ``CHUNK`` keys of each at a time."""
    at = [0] * len(runs)
    heap = [(int(keys[0]), n) for n, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    out_keys, out_counts = [], []
    while heap:
        bound = min(int(runs[n][0][min(at[n] + CHUNK, len(runs[n][0])) - 1]) for _, n in heap)
        parts = []
        while heap and heap[0][0] <= bound:
            _, n = heapq.heappop(heap)
            keys, counts = runs[n]
            to = at[n] + int(np.searchsorted(keys[at[n] : at[n] + CHUNK], np.uint64(bound), "right"))
            parts.append((keys[at[n] : to], counts[at[n] : to]))
            at[n] = to
            if to < len(keys):
                heapq.heappush(heap, (int(keys[to]), n))
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.uint64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        out_keys.append(keys[first])
        out_counts.append(np.add.reduceat(counts, first))
    return (np.concatenate(out_keys), np.concatenate(out_counts)) if out_keys else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _gaps_summed(blob: bytes, counts: str) -> tuple[np.ndarray, np.ndarray]:
    gaps, n = _unpacked(blob, "<u8", counts)
    return np.cumsum(gaps, dtype=np.uint64), n


def _count_slice(table: pa.Table) -> pa.Table:
    """The counts of one slice's runs."""
    keys, counts = merged([_gaps_summed(blob.as_py(), "<u4") for blob in table.column("keys")])
    return pa.table({"radix": table.column("radix")[:1].cast(pa.int32()), "keys": pa.array([_packed(np.diff(keys, prepend=np.uint64(0)), counts)], pa.binary())})


def _count_radix(table: pa.Table) -> pa.Table:
    """The counts of a radix, and which are the highest of their A id. At most one row for each pair of ids of a radix."""
    keys, counts = merged([_gaps_summed(blob.as_py(), "<u8") for blob in table.column("keys")])
    side = keys >> np.uint64(ID_BITS)
    first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])[: len(side)]
    best = counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.r_[first, len(side)])) if len(side) else counts
    blob = _packed(np.diff(keys, prepend=np.uint64(0)), counts, best.astype(np.uint32))
    return pa.table({"radix": table.column("radix")[:1].cast(pa.int32()), "counts": pa.array([blob], pa.binary())})


def _give_back(key: tuple, runs: pa.Table, counted: pa.Table) -> pa.Table:
    """For each run of a slice (there may be none): its documents with what this radix adds to them."""
    if not runs.num_rows:
        return pa.table({"run": pa.array([], pa.int64()), "given": pa.array([], pa.binary())})
    gaps, counts, best = _unpacked(counted.column("counts")[0].as_py(), "<u8", "<u8", "<u4")
    names = np.cumsum(gaps, dtype=np.uint64)
    out = []
    for keys_blob, docs_blob in zip(runs.column("keys"), runs.column("docs")):
        keys, sizes = _gaps_summed(keys_blob.as_py(), "<u4")
        docs, times = _unpacked(docs_blob.as_py(), "<u4", "<u4")
        at = np.searchsorted(names, keys)
        times = times.astype(np.int64)
        added = times * np.repeat(counts[at].astype(np.int64), sizes)
        bested = times * np.repeat(best[at].astype(np.int64), sizes)
        order = np.argsort(docs, kind="stable")
        sorted_docs = docs[order]
        first = np.flatnonzero(np.r_[True, sorted_docs[1:] != sorted_docs[:-1]])
        out.append(_packed(sorted_docs[first], np.add.reduceat(bested[order], first).astype(np.uint64), np.add.reduceat(added[order], first).astype(np.uint64)))
    return pa.table({"run": runs.column("run").cast(pa.int64()), "given": pa.array(out, pa.binary())})


def _fold_run(table: pa.Table) -> pa.Table:
    """A run's documents with the sums over all radices."""
    parts = [_unpacked(blob.as_py(), "<u4", "<u8", "<u8") for blob in table.column("given")]
    size = max(int(d[-1]) for d, _, _ in parts) + 1
    best, total, seen = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    for docs, b, t in parts:
        seen[docs] = True
        best[docs] += b.astype(np.int64)
        total[docs] += t.astype(np.int64)
    docs = np.flatnonzero(seen)
    run = table.column("run")[0].as_py()
    return pa.table({"run": pa.array([run] * len(docs), pa.int64()), "doc": pa.array(docs, pa.int32()), "n_best": best[docs], "count_sum": total[docs]})


def align_tokens(docs: DataFrame, model_a: str, model_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> DataFrame:
    """Per row: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (with ``keep_groups``) and groups_sha256.

    Side A reads a blank and the text, side B (which adds the blank itself) the
    text. Byte offsets where tokens of both sides end cut them into groups;
    links are the pairs of occurrences that share one. ``count_sum`` adds, over
    a row's links, in how many rows of the corpus the pair is linked; ``n_best``
    counts the links whose pair has the highest such count of its A id, ties
    included. Rows without a text, and those whose tokens of a side do not spell
    the text, have no tokens: zeros and an empty string. Each row is a document
    of its own, whatever its id (null and repeated ids too); equal texts count
    each. Other columns are not read. Both paths must exist on all executors.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType
    first = named.mapInArrow(_tokenise(model_a, model_b, to_arrow_type(kind), keep_groups), DIGEST.format(id=kind.simpleString()))
    first = written(first, "tokens")
    runs = first.where("radix IS NOT NULL").select("run", "radix", "keys", "docs")
    sizes = runs.groupBy("radix").agg(F.sum(F.length("keys") + F.length("docs")).alias("bytes"))
    sizes = sizes.select("radix", (F.col("bytes") / SLICE_BYTES + 1).cast("int").alias("slices"))  # at most RADIX rows
    sliced = runs.join(F.broadcast(sizes), "radix").withColumn("slice", F.pmod(F.xxhash64("run"), "slices").cast("int"))
    counted = sliced.select("radix", "slice", "keys").groupBy("radix", "slice").applyInArrow(_count_slice, "radix int, keys binary")
    counted = written(counted.groupBy("radix").applyInArrow(_count_radix, "radix int, counts binary"), "counts")
    counted = counted.join(F.broadcast(sizes), "radix").select("radix", "counts", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    given = sliced.groupBy("radix", "slice").cogroup(counted.groupBy("radix", "slice")).applyInArrow(_give_back, "run long, given binary")
    folded = given.groupBy("run").applyInArrow(_fold_run, "run long, doc int, n_best long, count_sum long")
    none = F.lit(0).cast("long")
    out = first.where("radix IS NULL").join(folded, ["run", "doc"], "left")
    groups = [F.col("groups")] if keep_groups else []
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), *groups, "groups_sha256")
