"""Batches of texts in pieces of bounded size.

A batch that Spark hands to Python has up to 10,000 texts, and what is found in a text,
as Python objects, takes many times its size. So results are made and sent on for some
texts at a time, however many a batch has; one longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Characters, or bytes, of the texts of a piece.
PIECE = 1 << 18


def cuts(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that are together at most so large, or one alone."""
    first = at = held = 0
    for at, n in enumerate(sizes, 1):
        if held and held + n > most:
            yield first, at - 1
            first, held = at - 1, 0
        held += n
    if first < at:
        yield first, at


def of_series(texts: pd.Series, most: int | None = None) -> Iterator[pd.Series]:
    """A series of texts, of which some are null, in pieces."""
    for a, z in cuts((len(x) if isinstance(x, str) else 0 for x in texts), most or PIECE):
        yield texts.iloc[a:z]


def of_batch(batch: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch with a column of texts in pieces."""
    for a, z in cuts(pc.binary_length(batch.column(column)).fill_null(0).to_pylist(), most or PIECE):
        yield batch.slice(a, z - a)
