"""Row functions over Arrow columns, in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows are turned into Python objects in pieces of about this many bytes of text.
PIECE_BYTES = 2 * 2**20


def pieces(columns: tuple[pa.Array, ...], size: int | None = None) -> Iterator[list[pa.Array]]:
    """The columns cut into runs of rows of about ``size`` bytes, or ``PIECE_BYTES``; a longer row is a piece of its own."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    piece = np.cumsum(sizes) // (size or PIECE_BYTES)
    borders = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
    for start, end in zip(borders, borders[1:]):
        yield [c.slice(start, end - start) for c in columns]


def row_by_row(function: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``function`` of the texts of each row; null where one of them is null.

    An Arrow frame can hold 64 MB of text, so it is never turned into Python objects as a whole.
    """
    found = [
        pa.array([None if None in row else function(*row) for row in zip(*(c.to_pylist() for c in piece))], kind)
        for piece in pieces(columns)
    ]
    return found[0] if len(found) == 1 else pa.concat_arrays(found)
