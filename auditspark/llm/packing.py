"""Compact binary columns for arrays of numbers that go through a shuffle.

Bytes of equal weight lie together, so that the compression of the shuffle finds the empty ones; sorted numbers are stored as
differences.
"""

from __future__ import annotations

import numpy as np


def planes(x: np.ndarray) -> bytes:
    """The numbers of an array, first all low bytes, then all next ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def sorted_planes(x: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers."""
    steps = x.astype(np.uint64)
    steps[1:] = x[1:] - x[:-1]
    return planes(steps)


def from_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows begin."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(fresh)


def doubled(parts: int) -> int:
    """Groups for so many partitions: two each on the average, so that few stay without one."""
    return 2 * parts
