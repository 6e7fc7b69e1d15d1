"""Content-determined anchors: every window of a text is held by the run of bytes in it with the least hash."""

from __future__ import annotations

import numpy as np

from foliant.llm.hashing import between, prefix

WINDOW = 200  # bytes of a string that counts as repeated
GRAM = 64  # bytes of the runs that are hashed
_RUNS = WINDOW - GRAM + 1  # runs in a window
_SEGMENT = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by minima from both ends of blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, context hash, first window, last window) of all anchors of a text.

    The anchor of a window is its run with the least hash, the leftmost of equal ones, so equal windows have equal
    anchors wherever they stand. A context is the bytes from the start of the anchor's first window to the end of its last.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for base in range(0, len(data) - WINDOW + 1, _SEGMENT):
        part = data[base : base + _SEGMENT + WINDOW - 1]
        table = prefix(part)
        at = np.arange(len(part) - GRAM + 1)
        h = between(table, at, at + GRAM)
        held = _least((h & ~_PLACE) | at.astype(np.uint64), _RUNS) & _PLACE  # by window
        first = np.flatnonzero(np.diff(held, prepend=np.uint64(1 << 40)) != 0)
        last = np.append(first[1:], len(held)) - 1
        out.append((h[held[first]], between(table, first, last + WINDOW), first + base, last + base))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
