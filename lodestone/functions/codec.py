"""Ascending integers as small binaries: differences as byte planes, compressed where they are many."""

from __future__ import annotations

import zlib

import numpy as np

#: Differences up to which nothing is compressed, and the sign of that.
FEW, PLAIN = 64, 0x80


def pack_ascending(values: np.ndarray) -> bytes:
    """Ascending longs: the first as it is, then differences in as many bytes as the largest needs."""
    if not len(values):
        return b""
    first = int(values[0]).to_bytes(8, "little", signed=True)
    if len(values) == 1:
        return b"\x81" + first
    steps = np.diff(values).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    if len(steps) <= FEW:
        return bytes([width | PLAIN]) + first + planes
    return bytes([width]) + first + zlib.compress(planes, 4)


def unpack_ascending(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    width, planes = blob[0] & ~PLAIN, blob[9:] if blob[0] & PLAIN else zlib.decompress(blob[9:])
    first = int.from_bytes(blob[1:9], "little", signed=True)
    steps = np.zeros((len(planes) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return first + np.concatenate([[0], np.cumsum(steps.reshape(-1).view("<u8").astype(np.int64))])
