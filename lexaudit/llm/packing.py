"""Numbers as compressed bytes, for messages between tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Compressed numbers; integers with the bytes of one place together, as
    sorted and small ones compress well that way. ``unpack`` must be told their
    kind if it is not int64."""
    raw = np.ascontiguousarray(values)
    if raw.dtype.kind in "iu":
        raw = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, kind: type = np.int64) -> np.ndarray:
    kind = np.dtype(kind)
    n = int.from_bytes(raw[:8], "little")
    data = np.frombuffer(pa.decompress(raw[8:], kind.itemsize * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(data.reshape(kind.itemsize, -1).T).view(kind).ravel() if kind.kind in "iu" else data.view(kind)


def pack_steps(values: np.ndarray) -> bytes:
    """Compressed integers of 64 bits by their differences, which are small
    where neighbours are alike or sorted."""
    whole = values.astype(np.int64)
    return pack(np.diff(whole, prepend=whole.dtype.type(0)))


def unpack_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


def pack_bytes(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_bytes(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
