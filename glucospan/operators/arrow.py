"""Sorted Arrow batches of a task, a few whole groups at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a row's keys are not those of the row before; the first row counts as a change."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for key in keys:
        column = batch.column(batch.schema.get_field_index(key))
        values = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, number of each row's group) of runs of whole groups, from batches sorted by the keys.

    A group that goes on in the next batch waits for it, so memory holds a batch and a group.
    """
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        edges = np.flatnonzero(changes(batch, keys))
        if held:
            # Does the held group go on? Its last row and the first one here tell.
            both = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks()
            if changes(both.to_batches()[0], keys)[1]:
                whole = joined(held)
                yield whole, np.zeros(whole.num_rows, np.int64)
                held = []
            elif len(edges) == 1:
                held.append(batch)
                continue
            else:
                held.append(batch.slice(0, edges[1]))
                whole = joined(held)
                yield whole, np.zeros(whole.num_rows, np.int64)
                held, edges = [], edges[1:]
        first, last = int(edges[0]), int(edges[-1])
        if last > first:
            part = batch.slice(first, last - first)
            marks = np.zeros(last - first, np.int64)
            marks[edges[1:-1] - first] = 1
            yield part, np.cumsum(marks)
        held = [batch.slice(last)]
    if held:
        whole = joined(held)
        yield whole, np.zeros(whole.num_rows, np.int64)
