"""Arrow batches in small parts, for functions that make much of each row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

_BYTES = 1 << 20


def slices(batch: pa.Array | pa.RecordBatch, limit: int = _BYTES) -> Iterator[pa.Array | pa.RecordBatch]:
    """The batch in order, in parts of at most ``limit`` bytes or one row, so what a task holds as Python objects
    doesn't grow with the batch."""
    if batch.nbytes <= limit or len(batch) < 2:
        yield batch
        return
    half = len(batch) // 2
    yield from slices(batch.slice(0, half), limit)
    yield from slices(batch.slice(half), limit)
