"""64-bit hashes of many spans at once."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15
_U = np.uint64
#: Odd 64-bit multipliers, one for each word of a shingle.
FACTORS = np.array([xxhash.xxh64_intdigest(b"word", i) | 1 for i in range(8)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit number over all bits."""
    h = (h ^ (h >> np.uint64(31))) * FACTORS[0]
    h = (h ^ (h >> np.uint64(29))) * FACTORS[1]
    return h ^ (h >> np.uint64(32))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _inverse() -> int:
    return pow(BASE, -1, 1 << 64)


def spans_hashed(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each span [first, last) of 64-bit values that depends on the values and their order alone."""
    bits = max(12, len(values).bit_length())
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _powers(BASE, bits)[: len(values)], out=sums[1:])
    return mixed((sums[last] - sums[first]) * _powers(_inverse(), bits)[first] + (last - first).astype(_U))
