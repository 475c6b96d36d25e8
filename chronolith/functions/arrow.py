"""Bodies of Arrow UDFs over long strings."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

ROWS = 64


def each(one: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """one of each row of columns. Few rows at a time are Python objects: an Arrow batch has up to 10,000 rows, each of any length."""
    parts = []
    for i in range(0, len(columns[0]), ROWS):
        parts.append(pa.array([one(*row) for row in zip(*(c.slice(i, ROWS).to_pylist() for c in columns), strict=True)], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
