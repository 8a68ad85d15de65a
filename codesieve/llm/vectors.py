"""Vectors as integers, and blocks of them in files of the shared folder."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def integers(column: pa.Array, scale: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the valid vectors, floor(scale * x) of them): int64, or Python integers where a component is beyond it.

    Null vectors and null or non-finite components are invalid; shorter vectors are filled up with zeros.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    valid = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
    valid[row[~np.isfinite(x)]] = False
    x[~np.isfinite(x)] = 0
    m = np.zeros((len(lengths), dims))
    m[row, place] = x
    m = m[valid]
    return np.flatnonzero(valid), m.astype(np.int64) if np.abs(m).max(initial=0) < 2**62 else np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)


def narrow(m: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type of 2, 4 or 8 bytes."""
    if m.dtype == object:
        return m
    most = np.abs(m).max(initial=0)
    return m.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8")


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of up to two dimensions one after the other; Python integers as text."""
    out = [struct.pack("<Q", len(arrays))]
    for a in arrays:
        kind = "O" if a.dtype == object else a.dtype.str
        data = ",".join(map(str, a.ravel())).encode() if kind == "O" else np.ascontiguousarray(a).tobytes()
        out.append(struct.pack("<4sQQQ", kind.encode(), len(a), a.shape[1] if a.ndim == 2 else 0, len(data)) + data)
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    n, at, out = *struct.unpack_from("<Q", data), 8, []
    for _ in range(n):
        kind, rows, columns, size = struct.unpack_from("<4sQQQ", data, at)
        at += 28
        kind = kind.rstrip(b"\0").decode()
        a = np.array([int(v) for v in data[at : at + size].decode().split(",")] if size else [], object) if kind == "O" else np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at)
        out.append(a.reshape(rows, columns) if columns else a)
        at += size
    return out
