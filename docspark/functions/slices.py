"""Parts of an Arrow batch: what is made of a text takes many times its bytes, so a batch is worked on a little at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on together, and what a row counts for beside its text.
SLICE, ROW = 1 << 20, 256


def row_slices(column: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """Runs of rows of a column of texts, or of lists of texts, of at most ``size`` bytes; a larger row is alone.

    No rows give one slice without rows.
    """
    lists = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    texts = column.flatten() if lists else column
    ends = _ends(pc.binary_length(texts))
    if lists:
        ends = ends[_ends(column.value_lengths())]
    ends = ends + ROW * np.arange(len(ends))
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
        yield column.slice(start, stop - start)
        start = stop
    if not len(column):
        yield column


def _ends(lengths: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))])
