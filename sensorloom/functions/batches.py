"""Arrow batches of rows that come sorted by series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kernels import run_starts


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Columns of numbers side by side, unknown ones as NaN."""
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]) if batch.num_rows else np.empty((0, len(names)))


def starts(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    """Where each row's run of equal keys begins."""
    codes = [pc.fill_null(batch.column(n).dictionary_encode().indices, -1).to_numpy().astype(np.int64) for n in names]
    key = codes[0]
    for more in codes[1:]:
        key = key * (batch.num_rows + 2) + more
    return run_starts(key)


def whole_runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a run of equal ``name`` ends, and where each row's run begins. The last run of a batch waits for the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        start = starts(rows, name)
        last = int(start[-1])
        held = rows.slice(last)
        if last:
            yield rows.slice(0, last), start[:last]
    if held is not None:
        yield held, starts(held, name)
