"""Vectorised word and shingle hashing of whole texts, for use inside tasks.

Words are maximal runs of anything but space and U+0009 to U+000D, after
lower-casing A-Z only; ``bytes.lower`` and ``bytes.split`` follow exactly
that rule on UTF-8. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20  # bytes hashed at a time; a longer text goes through in pieces
_U = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])  # breaks for words of letters and digits
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    global _powers
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + 4096)
        _powers = []
        for base in (_BASE, _INVERSE):
            t = np.full(n, base, _U)
            t[0] = 1
            _powers.append(np.multiply.accumulate(t))
    return _powers


def spans(raw: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end: runs of bytes that ``breaks`` does not mark."""
    space = breaks[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[0::2], edge[1::2]


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def _pieces(data: bytes) -> Iterator[bytes]:
    """Cut at white space, so that no word is split."""
    at = 0
    while len(data) - at > PIECE:
        to = at + PIECE
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        yield data[at:to]
        at = to
    yield data[at:]


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def words(text: str | None) -> list[bytes]:
    return lowered(text).split()


def word_hashes(texts: list[str | None], breaks: np.ndarray = _SPACE) -> list[np.ndarray]:
    """The hashes of each text's words, in order; short texts are hashed together."""
    out: list[np.ndarray] = []
    batch: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal batch, size
        if batch:
            raw = np.frombuffer(b"\n".join(batch), np.uint8)
            start, end = spans(raw, breaks)
            hashes = hash_spans(raw, start, end)
            cuts = np.searchsorted(start, np.cumsum([len(b) + 1 for b in batch[:-1]]))
            out.extend(np.split(hashes, cuts))
            batch, size = [], 0

    for text in texts:
        data = lowered(text)
        if size + len(data) > PIECE:
            flush()
        if len(data) > PIECE:
            parts = []
            for piece in _pieces(data):
                raw = np.frombuffer(piece, np.uint8)
                parts.append(hash_spans(raw, *spans(raw, breaks)))
            out.append(np.concatenate(parts))
        else:
            batch.append(data)
            size += len(data) + 1
    flush()
    return out


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole text if it is shorter."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    run = min(width, len(hashes))
    h = np.zeros(n, _U)
    for k in range(run):
        h = (h ^ hashes[k : k + n]) * _U(0xFF51AFD7ED558CCD)
        h = h ^ (h >> _U(32))
    return np.unique(mix(h + _U(run)))
