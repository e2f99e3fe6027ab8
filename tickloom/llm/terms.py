"""Terms of texts in Arrow batches: maximal runs of kept bytes, A-Z lower-cased, told apart by dictionary codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import row_chunks, text_buffers, word_class

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = word_class()
LETTERS = ALNUM.copy()
LETTERS[48:58] = False


def beginnings(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where terms begin among bytes of which ``inside`` belong to terms; no term crosses a row's offset."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    first[edges] = inside[edges]
    return first


def split(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of several rows, and where each row's terms start among them.

    ``offsets`` are the rows' byte offsets in ``data``; ``kept`` says which bytes belong to terms
    (all bytes of non-ASCII characters must).
    """
    inside = kept[data]
    at = np.flatnonzero(beginnings(inside, offsets))
    body = LOWER[data[inside]]
    place = np.cumsum(inside, dtype=np.int32)[at] - 1 if len(at) else np.zeros(0, np.int32)
    ends = np.append(place, np.int32(len(body))).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(body)), np.searchsorted(at, offsets)


def counted(column: pa.Array, kept: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(low, high, lengths, codes, rows, counts, dictionary) for stretches of rows of about ``size`` bytes of text.

    ``lengths`` has the number of terms of each row; (codes, rows, counts) the occurrences of each
    term in each row from ``low``, ordered by code and row. A longer row is a stretch of its own.
    """
    data, offsets = text_buffers(column)
    for low, high in row_chunks(offsets, size):
        words, starts = split(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], kept)
        encoded = words.dictionary_encode()
        lengths, n = np.diff(starts), high - low
        keys = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
        keys, counts = np.unique(keys, return_counts=True)
        yield low, high, lengths, keys // n, keys % n, counts, encoded.dictionary
