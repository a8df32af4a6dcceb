"""Cuts of a text at which a byte-level tokenizer always begins a new pre-token, and small Arrow helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

#: Rows handled at a time inside a task.
SLICE = 256
_SPACES = re.compile(r" \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """``text`` cut at spaces that open a pre-token; the space itself is left out.

    The pattern of the tokenizer joins a space to what follows, so a single space
    before a character that is not white space always begins a pre-token. Every
    piece but the first is thus encoded with one space before it.
    """
    return _CUT.split(text) if _SPACES.search(text) else text.split(" ")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(column: pa.Array) -> list[str]:
    """Strings of a column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]
