"""Sorting of suffixes to a fixed depth, deep-shallow.

To a shallow depth groups are split by eight bytes at a time, a multikey quicksort on wide letters. What is still equal
there tends to stay equal for long, so the rest is ordered by blind tries, built for all groups at once, level by level:
a node's members are compared with its first one; the length of the common prefix and the byte behind it are the
member's branch, and the bytes skipped are never looked at again. Members equal to full depth are done.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def wide_letters(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there as a number, zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint64)
    padded[: len(data)] = data
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def deep_shallow(letters: np.ndarray, place: np.ndarray, group: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``place``, by group and then by their first ``depth`` bytes (a multiple of 8).

    The second array tells which of them equal their predecessor to full depth. All suffixes must be that long.
    """
    n = len(place)
    order, same = np.argsort(group, kind="stable"), np.zeros(n, bool)
    cut = np.ones(n + 1, bool)  # slots at which a group begins
    cut[1:n] = np.diff(group[order]) != 0

    def open_(slots: np.ndarray) -> np.ndarray:
        return slots[~(cut[slots] & cut[slots + 1])]

    active = open_(np.arange(n))
    for at in range(0, shallow, 8):
        if not len(active):
            return order, same
        mine = np.cumsum(cut[active])
        letter = letters[place[order[active]] + at]
        by = np.lexsort((letter, mine))
        order[active] = order[active][by]
        letter = letter[by]
        cut[active[1:]] |= letter[1:] != letter[:-1]
        active = open_(active)
    while len(active):
        first = np.flatnonzero(cut[active])
        node = np.cumsum(cut[active]) - 1
        here = place[order[active]]
        there = here[first][node]
        common = np.full(len(active), depth)
        differ, left = np.zeros((len(active), 2), np.uint64), np.arange(len(active))
        for at in range(shallow, depth, 8):
            x, y = letters[here[left] + at], letters[there[left] + at]
            stop = x != y
            hit = left[stop]
            common[hit], differ[hit, 0], differ[hit, 1] = at, x[stop], y[stop]
            left = left[~stop]
            if not len(left):
                break
        for k in range(8):  # the byte within the letter
            shift = np.uint64(56 - 8 * k)
            undecided = (common < depth) & (common % 8 == 0) & ((differ[:, 0] >> shift) == (differ[:, 1] >> shift)) if k < 7 else np.zeros(len(active), bool)
            decided = (common < depth) & ~undecided & (differ[:, 0] != differ[:, 1])
            byte = ((differ[:, 0] >> shift) & np.uint64(255)).astype(np.int64)
            branch = np.where(decided, byte, 0) if k == 0 else np.where(decided, byte, branch)
            side = np.where(decided, np.where(differ[:, 0] < differ[:, 1], 0, 2), 1) if k == 0 else np.where(decided, np.where(differ[:, 0] < differ[:, 1], 0, 2), side)
            length = np.where(decided, common + k, depth) if k == 0 else np.where(decided, common + k, length)
            differ[decided, 0] = differ[decided, 1] = 0
        rank = np.where(side == 2, -length, length)  # nearer to the first member, longer in common
        by = np.lexsort((branch, rank, side, node))
        order[active] = order[active][by]
        node, side, rank, branch = node[by], side[by], rank[by], branch[by]
        new = np.append(True, (np.diff(node) != 0) | (np.diff(side) != 0) | (np.diff(rank) != 0) | (np.diff(branch) != 0))
        cut[active] |= new
        equal = side == 1
        same[active[equal & ~new]] = True
        active = open_(active[~equal])
    return order, same
