"""Rules that go row by row, as streams over sorted parts.

Rows are dealt by group and sorted; a Python worker reads its part as a stream
and starts anew where the group changes. Thousands of small groups share one
call and a large one is never held whole, unlike a call for each group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_NONE = object()


def _sorted(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*group).sortWithinPartitions(*group, *order)


def folded(rows: DataFrame, group: list[str], order: list[str], uses: list[str], start: Callable[[], object], step: Callable[..., object], name: str, kind: str) -> DataFrame:
    """``rows`` with a column ``name``: ``step(state, *uses)`` in order within the group, with a new ``start()`` for each group."""
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"`{name}` {kind}")])
    of = to_arrow_type(schema[name].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = _NONE, None
        for batch in batches:
            out = []
            for key, values in zip(_rows(batch, group), _rows(batch, uses)):
                if key != last:
                    last, state = key, start()
                out.append(step(state, *values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, of)], [*batch.schema.names, name])

    return _sorted(rows, group, order).mapInArrow(run, schema)


def grouped(rows: DataFrame, group: list[str], order: list[str], uses: list[str], run: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``run`` makes of each group's ``uses`` in order, after the group's columns; holds one group at a time."""
    out = StructType([*(rows.schema[g] for g in group), *StructType.fromDDL(schema)])
    kinds = [to_arrow_type(f.dataType) for f in out]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], out.names)

        last, held, done = _NONE, [], []
        for batch in batches:
            for key, values in zip(_rows(batch, group), _rows(batch, uses)):
                if key != last:
                    if held:
                        done.extend((*last, *r) for r in run(held))
                    last, held = key, []
                    if len(done) >= 10_000:
                        yield flush()
                        done = []
                held.append(values)
        if held:
            done.extend((*last, *r) for r in run(held))
        yield flush()

    return _sorted(rows, group, order).mapInArrow(whole, out)


def _rows(batch: pa.RecordBatch, names: list[str]) -> Iterable[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))
