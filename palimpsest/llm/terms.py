"""Terms of whole Arrow text columns: maximal runs of some bytes, lower-cased, as one Arrow array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textkit as tk


def inside(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes stand in terms: those of UTF-8 sequences, and the ASCII ranges given."""
    out = np.zeros(256, bool)
    out[128:] = True
    for low, high in ranges:
        out[low : high + 1] = True
    return out


LETTERS = inside((0x41, 0x5A), (0x61, 0x7A))
ALNUM = inside((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of ``member`` bytes, none across rows, and each run's row."""
    here = member[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    opens, closes = here & border[:-1], here & border[1:]
    opens[1:] |= here[1:] & ~here[:-1]
    closes[:-1] |= here[:-1] & ~here[1:]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1 - start, np.searchsorted(offsets, start, "right") - 1


def terms(column: pa.Array, member: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of a text column, the place of each occurrence's term among them, and its row; A-Z lower-cased, null has none."""
    data, offsets = tk.flat(column)
    _, length, row = spans(data, offsets, member)
    ends = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    letters = tk.LOWER[data[member[data]]]  # runs are maximal, so their bytes in a row are the terms in a row
    every = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    return every.dictionary, np.asarray(every.indices), row
