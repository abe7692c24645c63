"""Number columns of many rows as one binary value, so that a shuffle moves a few large
rows instead of many small ones. Bytes of equal weight stand together, and sorted
columns go as differences, so what is constant shrinks to nothing in Spark's codec."""

from __future__ import annotations

import struct

import numpy as np


def pack(*columns: np.ndarray) -> bytes:
    """Columns of the same length."""
    n = len(columns[0])
    parts = [struct.pack("<I", n)]
    for c in columns:
        parts.append(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes())
    return b"".join(parts)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", blob)
    out, at = [], 4
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(k).reshape(n))
        at += n * size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of int64, in a form that keeps small steps of either sign small."""
    d = np.diff(x, prepend=np.int64(0))
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def unsteps(z: np.ndarray) -> np.ndarray:
    d = (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)
    return np.cumsum(d)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of x."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def split(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each number in part with the places where it stands, in their order."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[x[0]]), x) for x in np.split(order, cuts)]
