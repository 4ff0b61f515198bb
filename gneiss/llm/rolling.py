"""Rolling 64-bit polynomial fingerprints and content-chosen sampling points over byte arrays.

All arithmetic is modulo 2**64 on numpy arrays.  Bytes go through a fixed random table first, so the
fingerprint of a window is ``sum(table[b[i]] * BASE**i) * BASE**-start``; windows are at most a few
hundred bytes, far below the lengths at which power-of-two moduli are known to be weak.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    with np.errstate(over="ignore"):  # numpy warns of scalars that wrap round, as they should here
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        have = _powers[kind] = out
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums ``P`` with which :func:`span` fingerprints any stretch of ``values`` (uint8 or uint64)."""
    n = len(values)
    terms = _TABLE[values] if values.dtype == np.uint8 else values
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(terms * _power("up", _BASE, n), out=out[1:])
    return out


def span(p: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints of ``values[start:stop]``, where ``p`` is ``prefix(values)``."""
    return (p[stop] - p[start]) * _power("down", _INVERSE, len(p))[start]


def every(p: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all stretches of ``width`` values."""
    n = len(p) - width
    return (p[width:] - p[:n]) * _power("down", _INVERSE, n)


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` entries of ``h`` the index of its smallest, the leftmost among equals.

    Only the upper 40 bits are compared, so ``len(h)`` must stay below 2**24.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    low = np.uint64((1 << 24) - 1)
    full = -(-len(h) // width) * width
    key = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    key[: len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    rows = key.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
