"""Numbers as compressed bytes, to send whole arrays as one value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_planes(x: np.ndarray) -> bytes:
    """How many numbers, then all first bytes, all second ones and so on (small numbers leave runs of zeros), compressed."""
    flat = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(pa.py_buffer(flat), "zstd", asbytes=True)


def from_planes(raw: pa.Scalar, dtype: type = np.int64) -> np.ndarray:
    raw, size = raw.as_buffer(), np.dtype(dtype).itemsize
    n = int.from_bytes(raw[:8], "little")
    flat = np.frombuffer(pa.decompress(raw.slice(8), n * size, "zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(dtype).reshape(-1)
