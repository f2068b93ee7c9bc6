"""Rolling hashes over byte arrays, modulo 2 ** 64, by sums of powers."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers of the rolling hash and of mixing.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    if name not in _POWERS or len(_POWERS[name]) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(m, base, np.uint64)
        steps[0] = 1
        _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS[name][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """The hash of each span raw[start:end] (end > start); equal bytes have equal hashes wherever they are."""
    if sums is None:
        sums = prefix_sums(raw)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    whole = (sums[ends - 1] - before) * powers("base", BASE, len(raw))[starts]
    return mixed(whole + (ends - starts).astype(np.uint64) * MIX)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(TABLE[raw] * powers("back", BACK, len(raw)))
