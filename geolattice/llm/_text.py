"""Words of whole batches at once, by Arrow kernels."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII characters that end a word.
_BLANK = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one large_string array, null read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column.cast(pa.large_string()), "")


def give_back() -> None:
    """Memory that this process holds and no longer uses goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which goes on to other tasks, keeps no memory that it doesn't use."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text each; a longer text stands alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words on end, and where each text's words begin (one more than texts).

    A word is what stands between white space and ASCII punctuation.
    """
    low = pc.utf8_lower(texts)
    if low.offset:
        low = pa.concat_arrays([low, pa.array([], low.type)])
    _, offsets, data = low.buffers()
    blank = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_BLANK))
    split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(low), offsets, blank))
    flat = split.flatten()
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(flat), 0)  # blanks at the ends split off an empty word
    if not pc.all(real, min_count=0).as_py():
        mask = real.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(size)), size)
        size = np.bincount(owner[mask], minlength=len(size))
        flat = flat.filter(real)
    return flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object), categorize=False)


def encoded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of each word among the distinct ones, and these."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def reduce_rows(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """ufunc.reduceat over the row ranges given by offsets, `empty` where a range is."""
    out = np.full((len(offsets) - 1, *values.shape[1:]), empty, values.dtype)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = ufunc.reduceat(values, offsets[some], axis=0)
    return out
