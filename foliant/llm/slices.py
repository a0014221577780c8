"""Arrow batches cut by the bytes that they hold, so that a worker's memory follows the longest text and not the batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE = 4 << 20


def sliced(batches, column: int, size: int = SLICE):
    """Slices of at least one row whose values in the (string or binary) column sum to about size bytes."""
    for batch in batches:
        array = batch.column(column)
        lengths = pa.compute.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns put in place of those of their name, or after the others."""
    have = dict(zip(batch.schema.names, batch.columns)) | columns
    return pa.RecordBatch.from_arrays(list(have.values()), names=list(have))
