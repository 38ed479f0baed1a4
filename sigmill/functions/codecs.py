"""Chunk codecs and reversible preprocessors, as array operations on one chunk."""

from __future__ import annotations

import bz2
import zlib
from functools import cache

import numpy as np
import pyarrow as pa

# The order is that of the bytes in capture files.
CODECS = ["None", "Zstd", "Lz4", "Snappy", "Zlib", "Lz4Hc", "BZip2"]
PREPROCESSORS = ["None", "Delta1", "Delta2", "Lpc", "ByteShuffle", "FloatXorDelta", "DeltaFloatPredictor", "IntDeltaZigZag"]
_ARROW = {"Zstd": "zstd", "Lz4": "lz4_raw", "Lz4Hc": "lz4_raw", "Snappy": "snappy"}


@cache
def _arrow(name: str) -> pa.Codec:
    return pa.Codec(_ARROW[name], compression_level=9) if name == "Lz4Hc" else pa.Codec(_ARROW[name])


def compress(data: bytes, codec: str) -> bytes:
    if codec == "Zlib":
        return zlib.compress(data, 6)
    if codec == "BZip2":
        return bz2.compress(data, 9)
    return data if codec == "None" else _arrow(codec).compress(data, asbytes=True)


def decompress(data: bytes, codec: str, size: int) -> bytes:
    if codec == "Zlib":
        return zlib.decompress(data)
    if codec == "BZip2":
        return bz2.decompress(data)
    return data if codec == "None" else _arrow(codec).decompress(data, decompressed_size=size, asbytes=True)


def _integrate(steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The series whose second differences are ``steps``, after its two values ``start``."""
    slope = start[1:] - start[:1] + np.cumsum(steps, dtype=steps.dtype)
    return start[1:] + np.cumsum(slope, dtype=steps.dtype)


def preprocess(data: bytes, name: str, order: int = 2) -> bytes:
    """The bytes that are compressed; a tail that makes no 4-byte word stays as it is."""
    b = np.frombuffer(data, np.uint8).copy()
    w = b[: len(b) // 4 * 4].view("<u4")
    order = min(max(order, 1), 4)
    if name in ("Delta1", "Delta2"):
        for _ in range(1 + (name == "Delta2")):
            b[1:] -= b[:-1].copy()
    elif name == "Lpc" and len(b) > order:
        guess = b[order - 1 : -1] if order == 1 else 2 * b[order - 1 : -1] - b[order - 2 : -2]
        b[order:] -= guess.copy()
    elif name == "ByteShuffle" and len(w) > 1:
        b[: 4 * len(w)] = b[: 4 * len(w)].reshape(-1, 4).T.ravel().copy()
    elif name == "FloatXorDelta":
        w[1:] ^= w[:-1].copy()
    elif name == "DeltaFloatPredictor" and len(w) > 2:
        w[2:] -= 2 * w[1:-1] - w[:-2]
    elif name == "IntDeltaZigZag" and len(w) > 1:
        step = (w[1:] - w[:-1]).view("<i4")
        w[1:] = (step << 1 ^ step >> 31).view("<u4")
    return b.tobytes()


def restore(data: bytes, name: str, order: int = 2) -> bytes:
    """The inverse of ``preprocess``."""
    b = np.frombuffer(data, np.uint8).copy()
    w = b[: len(b) // 4 * 4].view("<u4")
    order = min(max(order, 1), 4)
    if name in ("Delta1", "Delta2"):
        for _ in range(1 + (name == "Delta2")):
            b = np.cumsum(b, dtype=np.uint8)
    elif name == "Lpc" and len(b) > order:
        b[order:] = b[order - 1] + np.cumsum(b[order:], dtype=np.uint8) if order == 1 else _integrate(b[order:], b[order - 2 : order])
    elif name == "ByteShuffle" and len(w) > 1:
        b[: 4 * len(w)] = b[: 4 * len(w)].reshape(4, -1).T.ravel().copy()
    elif name == "FloatXorDelta" and len(w):
        w[:] = np.bitwise_xor.accumulate(w)
    elif name == "DeltaFloatPredictor" and len(w) > 2:
        w[2:] = _integrate(w[2:], w[:2])
    elif name == "IntDeltaZigZag" and len(w) > 1:
        step = w[1:] >> 1 ^ (np.uint32(0) - (w[1:] & 1))
        w[1:] = w[0] + np.cumsum(step, dtype=np.uint32)
    return b.tobytes()
