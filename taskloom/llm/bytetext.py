"""Texts of an Arrow column as one array of UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, where each starts, where each ends); null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, ends[:-1] - ends[0], ends[1:] - ends[0]


def cut_strings(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of an array of bytes, which may overlap, as an Arrow column of strings; every piece must be whole UTF-8."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    made = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat[at])))
    return made.cast(pa.string())
