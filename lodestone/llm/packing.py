"""Compressed arrays of unsigned integers, for rows that carry many values each."""

from __future__ import annotations

import numpy as np
import zstandard


def squeeze(values: np.ndarray, level: int = 3) -> bytes:
    """Unsigned integers as compressed byte planes; the first byte tells the width."""
    most = int(values.max()) if len(values) else 0
    width = 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def expand(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype(np.uint64)


def squeeze_sorted(values: np.ndarray) -> bytes:
    """As ``squeeze``, by differences: for ascending values."""
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def expand_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob), dtype=np.uint64)
