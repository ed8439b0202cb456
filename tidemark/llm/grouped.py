"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """The rows of each run of equal keys; the input is sorted by it."""
    held: dict[str, list] | None = None
    for batch in batches:
        rows = batch.to_pydict()
        keys = rows[key]
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if held and hi > lo and held[key][0] != keys[lo]:
                yield held
                held = None
            part = {c: v[lo:hi] for c, v in rows.items()}
            held = {c: held[c] + v for c, v in part.items()} if held else part
    if held and held[key]:
        yield held
