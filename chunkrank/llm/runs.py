"""Maximal runs of bytes of one class, as exact dictionary codes, for a slice of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of bytes with ``inside``, none across rows, and the row of each.

    The class must hold all bytes of a multi-byte character or none, so that every run is UTF-8.
    """
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:-1]
    starts = np.flatnonzero(first)
    kept = data[inside]
    # Inside the kept bytes alone the runs lie end to end.
    at = np.cumsum(inside, dtype=np.int64)[starts] - 1 if len(starts) else starts
    ends = np.append(at, len(kept)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept))
    return found, np.searchsorted(offsets, starts, side="right") - 1


def coded(found: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each string, equal for equal strings only, and the strings by number."""
    codes = found.dictionary_encode()
    return codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes.dictionary


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in one of the inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out
