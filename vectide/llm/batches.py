"""Help for mapInArrow functions over partitions that are sorted by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group begins, 0 included; equal nulls are one group."""
    new = np.zeros(table.num_rows, bool)
    if table.num_rows:
        new[0] = True
        for key in keys:
            column = table[key].combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks)
            a, b = column.slice(1), column.slice(0, len(column) - 1)
            differs = pc.fill_null(pc.not_equal(a, b), False)
            nulls = pc.not_equal(pc.is_null(a), pc.is_null(b))
            new[1:] |= np.asarray(pc.or_(differs, nulls))
    return np.nonzero(new)[0]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of at least `rows` rows, where there are so many, none of which cuts a group in two.

    The input is sorted by keys. Memory: `rows` plus the largest group.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            last = int(changes(table, keys)[-1])
            if last:
                yield table.slice(0, last)
                rest = table.slice(last)
                held, size = rest.combine_chunks().to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of about `rows` rows in the order they come."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
