"""Runs of equal keys over range partitions: a key that very many rows share is cut into pieces, not gathered in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[dict[str, np.ndarray], bool, bool]]:
    """columns, first and last of stretches of a task's sorted rows that hold whole runs of `key`.

    `first` and `last` tell that the stretch begins or ends the task, where a run may have been cut. What a long run has brought so
    far is a list of pieces, put together once.
    """
    held: list[dict[str, np.ndarray]] = []
    first = True
    together = lambda parts: {name: np.concatenate([x[name] for x in parts]) for name in parts[0]}
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        values = columns[key]
        start = int(np.searchsorted(values, values[-1]))
        if start or (held and held[-1][key][-1] != values[-1]):
            ended = [*held, {name: x[:start] for name, x in columns.items()}]
            yield together(ended), first, False
            first, held = False, []
        held.append({name: x[start:] for name, x in columns.items()})
    if held:
        yield together(held), first, True


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str, handle: Callable) -> Iterator[pa.RecordBatch]:
    """handle(columns, first, last) of all whole_runs."""
    for columns, first, last in whole_runs(batches, key):
        yield handle(columns, first, last)


def starts_of(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def in_key_order(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in ranges of the columns, sorted within each task."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)
