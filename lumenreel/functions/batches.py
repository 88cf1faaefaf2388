"""Arrow batches taken in pieces, so that few of their texts are Python strings at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of a piece; a longer text is a piece of its own.
PIECE = 1 << 20


def pieces(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each piece of some columns of text, in order; one empty piece where there are no rows."""
    n = len(columns[0])
    size = np.zeros(n, np.int64)
    for column in columns:
        size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // PIECE)) + 1).tolist(), n]
    for first, last in zip(bounds, bounds[1:], strict=False):
        yield first, last - first


@cache
def _trim() -> Callable[[int], int]:
    """What gives free memory back to the system, where the C library has it."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda spare: 0)


def give_back() -> None:
    """Free memory goes back to the system: the next task, of any stage, finds the same Python process."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def by_piece(use: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """use(lists of values of each column), piece by piece, as one array."""
    found = pa.concat_arrays([use(*(c.slice(first, n).to_pylist() for c in columns)) for first, n in pieces(*columns)])
    give_back()
    return found
