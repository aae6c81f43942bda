"""Sorted numbers packed into bytes: differences, cut into byte planes, compressed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def pack_sorted(keys: np.ndarray) -> bytes:
    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    return _squeeze(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return _squeeze(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def pack_floats(values: np.ndarray) -> bytes:
    """32-bit floats; the plane of signs and exponents shrinks to a fraction."""
    return _squeeze(values.astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_floats(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<f4").ravel()


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with summed counts."""
    k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    c = np.concatenate(counts) if counts else np.empty(0, np.int64)
    if not len(k):
        return k.astype(np.uint64), c.astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[head], np.add.reduceat(c, head)
