"""Benchmark passages in documents, by q-gram counts in diagonal bands and banded alignment.

Texts and items are compared on their letters and digits, case folded; everything else is dropped, with the place of
each sign kept. An occurrence of an item of n signs with at most e edits shares n - q + 1 - q*e of its q-grams
with the text, on diagonals (place in the text less place in the item) that differ by e at most. So every q-gram hit
is counted in bands of diagonals, 2e wide and overlapping by e: any occurrence lies within one of them. Bands that
reach the count are aligned, with only the diagonals of the band computed.

Items of fewer than LEAST signs are searched for without edits and must begin and end at a border of words; those of
fewer than Q signs are looked up by digests of their length.

Items of more than SEGMENT signs are also searched for in parts: segments of SEGMENT signs that overlap by half, each
with its own edits and count of q-grams. So any stretch of one and a half segments is found. Segments that follow one
another in item and text become one occurrence, unless one of the whole item covers them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.hashing import between, prefix
from foliant.llm.staging import stage

Q = 10
EDITS = 0.06  # of an item's signs
LEAST = 40  # signs from which an item may have edits; shorter ones must occur exactly
SEGMENT = 64  # signs of a part of an item: some dozen words
#: Characters of items that one broadcast index holds. More items are searched for in rounds of so many.
INDEX_CHARS = 2_000_000

_SEGMENT = 1 << 20
_FILTER_BITS = 22


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For all code points: the lower case (where it is one sign), and whether that is a letter or digit."""
    chars = [chr(c) for c in range(0x110000)]
    lower = np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    return lower, np.array([c.isalnum() for c in chars], bool)[lower]


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the letters and digits, and where each stands in the text."""
    lower, is_sign = _alphabet()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(is_sign[codes])
    return lower[codes[at]], at


def grams(signs: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all runs of q signs."""
    if len(signs) < q:
        return np.zeros(0, np.uint64)
    parts = []
    for lo in range(0, len(signs) - q + 1, _SEGMENT):
        table = prefix(signs[lo : lo + _SEGMENT + q - 1])
        start = np.arange(len(table) - q)
        parts.append(between(table, start, start + q))
    return np.concatenate(parts)


def allowed(size: int) -> int:
    """Edits that an occurrence of so many signs may have."""
    return int(size * EDITS) if size >= LEAST else 0


#: q-grams that an occurrence of a segment shares.
_SEGMENT_LEAST = SEGMENT - Q + 1 - Q * allowed(SEGMENT)


def _spaced(sign: int) -> bool:
    """Whether the sign is of a script that puts spaces between words."""
    return not (0x0E00 <= sign <= 0x0FFF or 0x1000 <= sign <= 0x109F or 0x1780 <= sign <= 0x17FF or 0x3040 <= sign <= 0x30FF or 0x3400 <= sign <= 0x9FFF or 0xF900 <= sign <= 0xFAFF or sign >= 0x20000)


def _border(signs: np.ndarray, where: np.ndarray, at: int) -> bool:
    """Whether no word goes on from the sign before ``at`` to the one there."""
    if at in (0, len(signs)) or where[at] > where[at - 1] + 1:
        return True
    return not (_spaced(int(signs[at - 1])) and _spaced(int(signs[at])))


def band_distance(item: np.ndarray, text: np.ndarray, lo: int, hi: int, limit: int) -> tuple[int, int, int] | None:
    """Least edits of the item against any stretch of the text, on diagonals lo..hi only: (edits, start, end) or None.

    Row i holds, per diagonal d, the edits of the first i signs ending at text place i + d.
    """
    d = np.arange(lo, hi + 1)
    far = limit + 1
    cost = np.where((d >= 0) & (d <= len(text)), 0, far)
    origin = d.copy()
    for i, sign in enumerate(item, 1):
        end = i + d  # place in the text after this row
        fits = (end >= 1) & (end <= len(text))
        same = np.full(len(d), False)
        same[fits] = text[end[fits] - 1] == sign
        step = np.where(fits, cost + ~same, far)
        drop = np.append(cost[1:] + 1, far)  # the sign of the item is missing in the text
        took = drop < step
        new, start = np.where(took, drop, step), np.where(took, np.append(origin[1:], 0), origin)
        new = np.where((end >= 0) & (end <= len(text)), new, far)
        # Signs that the text has besides: each costs one, from the cheapest place to the left.
        level = new - np.arange(len(d))
        best = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == best, np.arange(len(d)), 0))
        cost, origin = best + np.arange(len(d)), start[source]
        cost = np.where((end >= 0) & (end <= len(text)), cost, far)
        if cost.min() > limit:
            return None
    k = int(cost.argmin())
    return int(cost[k]), int(origin[k]), int(len(item) + d[k])


@dataclass
class Index:
    """Items by q-gram: sorted hashes, and for each the item and the place in it."""

    ids: list[int]
    signs: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    least: np.ndarray  # q-grams that an occurrence of each item shares
    present: np.ndarray  # by the upper bits of a hash: whether the index may hold it
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length, below Q: sorted hashes and their items

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> "Index":
        ids, signs = [], []
        for item_id, text in items:
            found = normalise(text)[0]
            if len(found):
                ids.append(item_id)
                signs.append(found)
        parts = [grams(s) for s in signs]
        hashes = np.concatenate([*parts, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        place = np.concatenate([*(np.arange(len(p)) for p in parts), np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        present = np.zeros(1 << _FILTER_BITS, bool)
        present[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        least = np.array([max(1, len(s) - Q + 1 - Q * allowed(len(s))) for s in signs], np.int64)
        short = {}
        for size in sorted({len(s) for s in signs if len(s) < Q}):
            own = np.array([i for i, s in enumerate(signs) if len(s) == size])
            digests = np.array([grams(signs[i], size)[0] for i in own], np.uint64)
            by_digest = np.argsort(digests, kind="stable")
            short[size] = (digests[by_digest], own[by_digest])
        return cls(ids, signs, hashes[order], item[order].astype(np.int64), place[order].astype(np.int64), least, present, short)

    def _short(self, signs: np.ndarray, where: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Occurrences of the items of fewer than Q signs."""
        found = []
        for size, (digests, items) in self.short.items():
            own = grams(signs, size)
            first, last = np.searchsorted(digests, own, "left"), np.searchsorted(digests, own, "right")
            for d in np.flatnonzero(last > first).tolist():
                if _border(signs, where, d) and _border(signs, where, d + size):
                    for i in items[first[d] : last[d]].tolist():
                        if np.array_equal(signs[d : d + size], self.signs[i]):
                            found.append((self.ids[i], int(where[d]), int(where[d + size - 1]) + 1, 0))
        return found

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of the occurrences; the places are code points of the text."""
        signs, where = normalise(text)
        found = self._short(signs, where)
        own = grams(signs)
        maybe = np.flatnonzero(self.present[own >> np.uint64(64 - _FILTER_BITS)])
        own = own[maybe]
        first, last = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        n = last - first
        if not n.any():
            return found
        at = np.repeat(maybe, n)
        entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, diagonal = self.item[entry], at - self.place[entry]
        total = np.bincount(item, minlength=len(self.ids))
        size = np.array([len(x) for x in self.signs])
        least = np.where(size > SEGMENT, np.minimum(self.least, _SEGMENT_LEAST), self.least)
        for i in np.flatnonzero(total >= least).tolist():
            own = item == i
            mine, begin = diagonal[own], at[own]
            hits = _occurrences(signs, self.signs[i], mine, int(self.least[i])) if total[i] >= self.least[i] else []
            if size[i] < LEAST:
                hits = [h for h in hits if _border(signs, where, h[0]) and _border(signs, where, h[1])]
            if size[i] > SEGMENT:
                free = np.ones(len(begin), bool)
                for start, end, _ in hits:
                    free &= (begin < start) | (begin >= end)
                if free.sum() >= _SEGMENT_LEAST:
                    hits += [h for h in _parts(signs, self.signs[i], mine[free], begin[free]) if not any(h[0] < end and start < h[1] for start, end, _ in hits)]
            found += [(self.ids[i], int(where[start]), int(where[end - 1]) + 1, edits) for start, end, edits in hits]
        return found


def _occurrences(signs: np.ndarray, part: np.ndarray, mine: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of ``part`` among the signs of a text, from the diagonals of its q-gram hits."""
    found, size, edits = [], len(part), allowed(len(part))
    width = edits + 1  # bands [k*width, (k+2)*width): they overlap by more than the edits
    bands, count = np.unique(np.concatenate([mine // width, mine // width - 1]), return_counts=True)
    straight, hits = np.unique(mine, return_counts=True)
    for d in straight[hits == size - Q + 1].tolist():  # all q-grams on one diagonal: no edits
        if d >= 0 and np.array_equal(signs[d : d + size], part):
            found.append((d, d + size, 0))
            bands, count = (x[(bands != d // width) & (bands != d // width - 1)] for x in (bands, count))
    done = None
    for band in bands[count >= least].tolist():
        base = max(0, band * width)
        shift = band * width - base  # diagonals before the text begins
        hit = band_distance(part, signs[base : base + 2 * width + size + edits], shift, shift + 2 * width - 1, edits)
        if hit is None:
            continue
        start, end = base + max(0, hit[1]), min(len(signs), base + hit[2])
        if done and start < done[1]:  # the overlapping band saw the same one
            if hit[0] < done[2]:
                found[-1] = done = (start, end, hit[0])
            continue
        done = (start, end, hit[0])
        found.append(done)
    return found


def _parts(signs: np.ndarray, whole: np.ndarray, mine: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, edits) of stretches that hold segments of an item; edits are those of the stretch."""
    place = begin - mine
    hits = []  # start and end in the text, start and end in the item, edits
    for lo in [*range(0, len(whole) - SEGMENT, SEGMENT // 2), len(whole) - SEGMENT]:
        inside = (place >= lo) & (place <= lo + SEGMENT - Q)
        if inside.sum() >= _SEGMENT_LEAST:
            part = whole[lo : lo + SEGMENT]
            hits += [(start, end, lo, lo + SEGMENT, edits) for start, end, edits in _occurrences(signs, part, mine[inside] + lo, _SEGMENT_LEAST)]
    runs = []
    for hit in sorted(hits):
        last = runs[-1] if runs else None
        slack = last and last[4] + hit[4]
        if last and hit[0] < last[1] and last[2] <= hit[2] <= last[3] and abs((hit[0] - hit[2]) - (last[0] - last[2])) <= slack:
            start, end, lo, hi = last[0], max(last[1], hit[1]), last[2], max(last[3], hit[3])
            base = max(0, start - slack)
            exact = band_distance(whole[lo:hi], signs[base : end + slack], 0, start - base + slack, slack)
            runs[-1] = (start, end, lo, hi, exact[0] if exact else slack)
        elif last and hit[0] < last[1]:  # a stretch that repeats within the item
            runs[-1] = (last[0], max(last[1], hit[1]), *last[2:])
        else:
            runs.append(hit)
    found = []
    for start, end, lo, hi, edits in runs:
        while lo and start and signs[start - 1] == whole[lo - 1]:
            start, lo = start - 1, lo - 1
        while hi < len(whole) and end < len(signs) and signs[end] == whole[hi]:
            end, hi = end + 1, hi + 1
        found.append((start, end, edits))
    return found


def _rounds(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of INDEX_CHARS characters at most (one item at least), one list at a time."""
    held, size = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        if held and size + len(row["text"]) > INDEX_CHARS:
            yield held
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if held:
        yield held


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per occurrence; ``docs`` has a long ``doc_id`` and ``text``."""
    fields = "doc_id long, item_id long, start long, end long, edits int"
    found = docs.sparkSession.createDataFrame([], fields)
    for items in _rounds(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index.of(items))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(doc_id, *hit) for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for hit in index.value.search(text)]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.int32()])], names=["doc_id", "item_id", "start", "end", "edits"])

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(search, fields))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per occurrence: doc_id, item_id, start, end (code points of the text, end exclusive), edits.

    Items of under 40 letters and digits are found where they occur without edits and as whole words.
    Of items of more than 64, parts are found too: any stretch of 96, or a segment of 64 from a multiple of 32 on or at
    the end; start, end and edits are then those of the part, and an item may have several rows.
    Null items, items without letter or digit and null or empty texts give nothing. Every round of items reads the
    texts once, so a benchmark of any size is searched for whole. Rows that repeat or have no doc_id report each; other
    columns are not looked at.
    """
    return _hits(docs.where("text is not null").select(F.col("doc_id").cast("long"), "text"), benchmark)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no occurrence of an item, unchanged.

    Each row is judged by its own text, whatever its doc_id: rows without one and rows that share one too.
    """
    rows = stage(docs.select("*", F.monotonically_increasing_id().alias("leak row")), "numbered")
    found = _hits(rows.where("text is not null").select(F.col("leak row").alias("doc_id"), "text"), benchmark)
    return rows.join(found.select(F.col("doc_id").alias("leak row")).distinct(), "leak row", "left_anti").drop("leak row")
