"""Python steps take their Arrow batches in slices of bounded text, so what they build stays small."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd

SLICE_SIZE = 1 << 20  # characters or bytes of a slice, unless one row alone has more
SLICE_ROWS = 1_000


def size_of(value) -> int:
    """Characters or bytes of a text, or of all texts of a list."""
    if isinstance(value, (str, bytes, bytearray, memoryview)):
        return len(value)
    if hasattr(value, "__iter__"):
        return sum(map(size_of, value))
    return 0


def bounds(sizes: Sequence[int]) -> Iterator[slice]:
    """Runs of neighbouring rows; no rows are one empty run."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > SLICE_SIZE or i - start >= SLICE_ROWS):
            yield slice(start, i)
            start, total = i, 0
        total += n
    yield slice(start, len(sizes))


def frame_slices(frames: Iterator[pd.DataFrame], columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The rows of the frames in smaller ones, measured by these columns."""
    for pdf in frames:
        sizes = [sum(map(size_of, row)) for row in zip(*(pdf[c] for c in columns))] if len(columns) else [0] * len(pdf)
        for part in bounds(sizes):
            yield pdf.iloc[part]
