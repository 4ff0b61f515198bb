"""Words of UTF-8 texts as 64-bit fingerprints: A-Z lower-cased, split at space and bytes 9 to 13."""

from __future__ import annotations

import numpy as np

from gneiss.llm.rolling import mix, prefix, span

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


def fingerprints(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and fingerprint of every word of the texts ``raw[at[i]:at[i + 1]]``, in order."""
    row, start, stop = places(raw, at)
    p = prefix(_LOWER[raw])
    return row, mix(span(p, start, stop) + (stop - start).astype(np.uint64) * _STEP)


def places(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, start and end of every word."""
    inside = ~_GAP[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(opens)
    return np.searchsorted(at, start, side="right") - 1, start, np.flatnonzero(closes) + 1


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def shingles(row: np.ndarray, word: np.ndarray, n_rows: int, k: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """All runs of ``k`` words as fingerprints, with row bounds; a row of fewer words gives one run of all of them.

    With a ``weight`` for each word a third array has the sum of each run's weights.
    """
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    full = max(len(word) - k + 1, 0)
    h = np.zeros(full, dtype=np.uint64)
    total = np.zeros(full, dtype=np.int64)
    for i in range(k):
        h = mix(h * _STEP + word[i : i + full])
        if weight is not None:
            total += weight[i : i + full]
    inside = (row[:full] == row[k - 1 :]) if full else np.zeros(0, dtype=bool)
    pieces, total, sizes = h[inside], total[inside], np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        heavy = np.zeros(len(short), dtype=np.int64)
        for i in range(k - 1):
            more = count[short] > i
            extra[more] = mix(extra[more] * _STEP + word[first[short[more]] + i])
            if weight is not None:
                heavy[more] += weight[first[short[more]] + i]
        extra = mix(extra + count[short].astype(np.uint64))
        at = np.concatenate(([0], np.cumsum(sizes)))[short]
        pieces, total = np.insert(pieces, at, extra), np.insert(total, at, heavy)
        sizes[short] = 1
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return (pieces, bounds) if weight is None else (pieces, bounds, total)
