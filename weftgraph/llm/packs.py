"""Arrays packed into one compressed binary value, for rows that travel between tasks."""

from __future__ import annotations

import numpy as np
import zstandard


def squeeze(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed value: number and sizes, then the bytes."""
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unsqueeze(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u8", n, 8)).tolist()
    at = 8 * (n + 1)
    return [raw[at + a:at + b] for a, b in zip([0, *ends], ends)]


def planes(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers with their bytes in separate planes, which compress better."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(
        values.astype(kind, copy=False).view(np.uint8).reshape(-1, width).T).tobytes()


def unplanes(data: bytes, kind: str = "<u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(
        np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()
