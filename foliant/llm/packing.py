"""Sorted hashes and small numbers as bytes, for lists that are sent between batches and parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers from 0 up as the smallest whole numbers that hold them, compressed."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or values.max() <= np.iinfo(k).max)
    raw = values.astype(kind).tobytes()
    return bytes([np.dtype(kind).itemsize]) + len(raw).to_bytes(8, "big") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack_numbers(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[1:9], "big")
    raw = pa.decompress(data[9:], size, "zstd", asbytes=True) if size else b""
    return np.frombuffer(raw, f"u{data[0]}").astype(np.int64)


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ordered by part (key modulo ``parts``) and key, and the place of each key among them."""
    distinct, at = np.unique(keys, return_inverse=True)
    order = np.argsort(distinct % np.uint64(parts), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[at]


def pack_keys(keys: np.ndarray, parts: int) -> bytes:
    """Ascending keys of one part: the steps between them, byte by byte, so that the bytes that are all 0 compress."""
    steps = np.diff(keys // np.uint64(parts), prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes, part: int, parts: int) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(steps.astype(np.uint64)) * np.uint64(parts) + np.uint64(part)
