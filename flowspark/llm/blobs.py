"""Compact columns of numbers inside binary values, for exchanges of very many small keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an unsigned array: equal places of all numbers lie together."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return len(values).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, dtype)
    raw = _CODEC.decompress(blob[8:], n * dtype.itemsize, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    """The same for numbers in ascending order: differences are stored."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(blob, dtype), dtype=dtype)
