"""Words of many texts at once, as numpy offsets into one byte buffer.

White space and words are those of ``tables.WORD``: only ASCII bytes separate words, so the search
can run on UTF-8 bytes without decoding them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: everything in ASCII but letters and digits; other bytes belong to letters of more than one byte
NO_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    """`text` holds all words with one blank behind each; word i is text[start[i]:end[i]].

    Document d owns the words first[d] to first[d + 1] - 1.
    """

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def give_back() -> None:
    """Return freed memory to the system: a worker process lives on, and what one stage took would count for the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece take about `most_bytes`; a longer text stands alone."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, base + most_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


def words(texts: pa.Array, lower: bool = False, between: np.ndarray = _BLANK) -> Words:
    """All words of `texts` (null: none), cut at the bytes in `between` (line feed is one); `lower` folds A-Z only."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    closed = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    offsets = np.frombuffer(closed.buffers()[1], np.int64, len(closed) + 1, closed.offset * 8)
    raw = closed.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    blank = between[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(texts) + 1, np.int64))
    ends = blank.copy()
    ends[1:] &= ~blank[:-1]
    ends[0] = False
    keep = ~blank | ends
    text = data[keep].copy()
    closing = np.flatnonzero(ends[keep])
    text[closing] = 0x20
    start = np.concatenate([[0], closing[:-1] + 1]) if len(closing) else closing
    first = np.searchsorted(np.flatnonzero(ends), bounds, side="left")
    return Words(text, start.astype(np.int64), closing.astype(np.int64), first.astype(np.int64))


def as_array(found: Words) -> pa.Array:
    """The words as an Arrow array of binary values."""
    solid = np.ones(len(found.text), bool)
    solid[found.end] = False
    sizes = found.end - found.start
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(found.text[solid])])


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of `values` per document; zero where a document has none."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
