"""Arrow functions that turn a batch into Python values a few rows at a time,
so that a worker holds a batch in Arrow and only a slice of it as objects."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

SLICE = 64


def by_slices(convert: Callable[..., pa.Array], to: pa.DataType, rows: int = SLICE) -> Callable[..., pa.Array]:
    """``convert`` of whole columns as a function that calls it on ``rows``
    rows at a time."""
    def batch(*columns: pa.Array) -> pa.Array:
        done = [convert(*(c.slice(at, rows) for c in columns)) for at in range(0, len(columns[0]), rows)]
        return pa.concat_arrays(done) if done else pa.array([], to)
    return batch
