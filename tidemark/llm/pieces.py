"""SentencePiece encoding and decoding: merge-type models, encoded by backtracking.

A sequence of pieces is the result of merging if and only if merging any two
neighbours of it again gives just those two. So the text is covered by longest
matches from left to right (Aho-Corasick), each checked against its neighbour;
where none fits, the last piece gives way to a shorter one, and a bit for each
position tells that nothing can follow there. As the pieces up to a position
are always the one right encoding of that prefix, a bit does not depend on how
the position was reached, and each position is left for good at most once.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.scratch import small_batches

SPACE = "▁"  # stands for a blank inside pieces
NORMAL, BYTE, MERGES = 1, 6, 2  # fixed values of the model's file format: types of pieces, type of model
LONG_WORD = 48  # characters; longer words are not kept
KEPT = 300_000  # words, and pairs of pieces, that a worker keeps; then it begins anew
NO_RANK = 1 << 60


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of a serialised message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if key & 7 == 5 else 8
            yield key >> 3, struct.unpack("<f" if size == 4 else "<d", data[at : at + size])[0]
            at += size


class _Known(dict):
    """A dict that makes missing values; once it holds ``KEPT`` it begins anew, and takes over what is asked for again."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= KEPT:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class _Single(dict):
    """Ids of characters; -1 for a character that is no piece."""

    def __missing__(self, key):
        return -1


class Pieces:
    """A model of merge type with byte fallback and without a character map."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        kinds, scores, self.pieces = [], [], []
        for name, value in model:
            if name == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, NORMAL))
        trainer, normaliser = (dict(_fields(b"".join(v for k, v in model if k == n))) for n in (2, 3))
        whole = trainer.get(3) == MERGES and trainer.get(35) and not trainer.get(24) and not normaliser.get(2) and not normaliser.get(4) and normaliser.get(5, 1)
        if not whole or set(kinds) - {NORMAL, 2, 3, BYTE}:
            raise ValueError("the model must be of merge type, with byte fallback, escaped blanks, no character map and no user-defined pieces")
        self.prefix = SPACE if normaliser.get(3, 1) else ""
        ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        if any(c not in ids for p in ids for c in p):
            raise ValueError("each character of a piece must be a piece")
        order = {s: n for n, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        self.rank = {p: order[scores[i]] for p, i in ids.items()}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.surface = [p.replace(SPACE, " ") if kinds[i] == NORMAL else "" for i, p in enumerate(self.pieces)]
        self.length = [len(p) for p in self.pieces]
        reached = {p: i for p, i in ids.items() if not self._crossing(p, -1)}  # others never come out of merging
        self.shorter = [-1] * len(self.pieces)  # the longest other piece that begins a piece
        for p, i in reached.items():
            self.shorter[i] = next((reached[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in reached), -1)
        self.automaton = ahocorasick.Automaton()
        for p, i in reached.items():
            if len(p) > 1:
                self.automaton.add_word(p, i)
        self.single = _Single((p, i) for p, i in reached.items() if len(p) == 1)
        self.automaton.make_automaton()
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in ids)  # no piece goes on with a blank: words are merged apart
        self.fits = _Known(self._fit)
        self.words = _Known(self._word)

    def _crossing(self, text: str, border: int) -> bool:
        """Merges the characters: whether two parts meet across the border; without one (-1), whether more than one part is left."""
        parts = list(text)
        rank = self.rank
        ranks = [rank.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            if i == border - 1:
                return True
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < border:
                border -= 1
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], NO_RANK)
        return border < 0 and len(parts) > 1

    def _fit(self, pair: int) -> bool:
        """Whether merging two neighbours, ``first << 20 | second``, gives them again."""
        first, second = pair >> 20, pair & (1 << 20) - 1
        return not self._crossing(self.pieces[first] + self.pieces[second], self.length[first])

    def _word(self, word: str) -> list[int]:
        """Ids of a text that is merged by itself."""
        longest, length = list(map(self.single.__getitem__, word)), self.length
        for end, i in self.automaton.iter(word):  # of matches with one start the longest comes last
            longest[end + 1 - length[i]] = i
        if -1 not in longest:
            return self._backtrack(0, len(word), longest)
        out, begin = [], 0
        for end in [*(n for n, i in enumerate(longest) if i < 0), len(word)]:  # characters of no piece
            out += self._backtrack(begin, end, longest)
            if end < len(word):
                out += [self.byte_id[b] for b in word[end].encode()]
            begin = end + 1
        return out

    def _backtrack(self, begin: int, end: int, longest: list[int]) -> list[int]:
        """Ids of the characters from ``begin`` to ``end``, all of which are pieces."""
        failed = bytearray((end - begin >> 3) + 1)
        out: list[int] = []
        at, piece, last = begin, longest[begin] if begin < end else -1, -1
        length, shorter, fits = self.length, self.shorter, self.fits
        while at < end:
            if piece < 0:  # nothing goes on from here
                failed[at - begin >> 3] |= 1 << (at - begin & 7)
                piece = out.pop()
                last = out[-1] if out else -1
                at -= length[piece]
                piece = shorter[piece]
                continue
            after = at + length[piece]
            if after <= end and not failed[after - begin >> 3] >> (after - begin & 7) & 1 and (last < 0 or fits[last << 20 | piece]):
                out.append(piece)
                at, last = after, piece
                piece = longest[at] if at < end else -1
            else:
                piece = shorter[piece]
        return out

    def encode(self, text: str) -> list[int]:
        """The ids without begin and end; an empty text has none."""
        if not text:
            return []
        text = self.prefix + text.replace(" ", SPACE)
        if not self.apart:
            return self._word(text)
        words = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)
        known = self.words
        if max(map(len, words)) <= LONG_WORD:
            return list(chain.from_iterable(map(known.__getitem__, words)))
        return list(chain.from_iterable(known[w] if len(w) <= LONG_WORD else self._word(w) for w in words))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no character become U+FFFD each, control pieces nothing."""
        parts = list(map(self.surface.__getitem__, ids))
        byte_of = self.byte_of
        if not byte_of.keys().isdisjoint(ids):
            held = bytearray()
            for n, i in enumerate(ids):
                if i in byte_of:
                    held.append(byte_of[i])
                if held and (i not in byte_of or n + 1 == len(ids)):
                    last = n if i in byte_of else n - 1
                    parts[last] = _characters(bytes(held))
                    held.clear()
        text = "".join(parts)
        first = next((i for i in ids if self.pieces[i] not in ("<s>", "</s>")), None)
        return text[1:] if self.prefix and first is not None and self.pieces[first].startswith(SPACE) else text


def _characters(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is in no character."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[: e.start].decode() + "�" + _characters(data[e.start + 1 :])


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    """The model of a file, once for each Python worker."""
    return Pieces(path)


def _added(df: DataFrame, name: str, kind: T.DataType, arrow: pa.DataType, source: str, make: Callable[[], Callable]) -> DataFrame:
    """``df`` with a column made from another, batch by batch; a column of that name is replaced."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            values = pa.array([one(x) for x in batch.column(source)], arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), values], [*kept, name])

    return df.mapInArrow(run, schema)


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as array<int>, as the library encodes it without sampling.

    Null and empty texts have an empty array. Rows are encoded by themselves, so
    repeated rows and null ids change nothing; other columns pass through, one
    named ``ids_col`` is replaced. ``model`` is a path that every executor has.
    """

    def make() -> Callable:
        pieces = load_pieces(model)
        return lambda x: pieces.encode(x.as_py() or "")

    return _added(docs, ids_col, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), text_col, make)


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of each array of ids; an empty or null array gives an empty text."""

    def make() -> Callable:
        pieces = load_pieces(model)
        return lambda x: pieces.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else ""

    return _added(rows, text_col, T.StringType(), pa.string(), ids_col, make)
