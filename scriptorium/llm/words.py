"""Words of letters and digits, lower-cased in A-Z only, cut from UTF-8 without decoding it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: ASCII letters, digits and all bytes of other characters stay; everything else is a blank.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20


def words(raw: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lists, each of about `piece` bytes of it, so that a long text's words aren't all held."""
    at = 0
    while at < len(raw):
        end = at + piece
        part = raw[at:end].translate(_TABLE)
        if end < len(raw):
            last = part.rfind(b" ")
            while last < 0 and end < len(raw):  # a word longer than a piece
                part += raw[end : end + piece].translate(_TABLE)
                end += piece
                last = part.rfind(b" ")
            if last >= 0 and end < len(raw):
                end -= len(part) - last - 1  # beyond the blank, so that each piece moves on
                part = part[:last]
        at = end
        if found := part.split():
            yield found


def texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    """A string column of a batch in UTF-8, one after the other; null is empty."""
    for x in batch.column(column).cast(pa.binary()):
        yield x.as_py() or b""
