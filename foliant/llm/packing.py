"""Best-fit-decreasing packing of token sequences.

Pieces of one length are interchangeable, so the packing of any number of pieces follows from how many there are of
each length. That table has ``capacity`` rows, whatever the corpus. The driver runs best fit decreasing over it, with
a segment tree over the remaining capacities, and yields a plan of runs: "pieces r0 to r1 of this length go to bins b0
on, q to a bin, from this offset". Pieces get their rank within their length by counts per task, so no group of
equal lengths is ever gathered, and each piece finds its run by binary search.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.staging import stage
from foliant.llm.tokens import encoder, slices, vocabulary

CAPACITY = 2048
SEPARATOR = 0
_RANKS = 1 << 44  # more than there are pieces of one length


class OpenBins:
    """Runs of equal bins by remaining capacity, with a segment tree that finds the tightest one that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.used = bytearray(2 * self.leaves)  # a node is set while a capacity below it has an open bin
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, bins: int) -> None:
        self.runs.setdefault(room, []).append((first, bins))
        node = self.leaves + room
        while node and not self.used[node]:
            self.used[node] = 1
            node //= 2

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity of at least ``size`` that has a bin."""
        node = self.leaves + size
        while not self.used[node]:
            while node & 1:  # a right child: the subtree to the right hangs on an ancestor
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.used[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        node = self.leaves + room
        if not self.runs[room]:
            self.used[node] = 0
            while node > 1 and not self.used[node ^ 1]:
                node //= 2
                self.used[node] = 0
        return run


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces to a bin, offset), ascending by length and rank."""
    plan, bins, new = [], OpenBins(capacity), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first = capacity, new
                open_bins = -(-left // (capacity // length))
                new += open_bins
            else:
                first, open_bins = bins.take(room)
            fit = room // length  # the bin stays the tightest one until it is full
            filled = min(open_bins, left // fit)
            rest = min(left - filled * fit, fit - 1) if filled < open_bins else 0
            if filled:
                plan.append((length, rank, first, fit, capacity - room))
                bins.add(room - fit * length, first, filled)
            if rest:
                plan.append((length, rank + filled * fit, first + filled, fit, capacity - room))
                bins.add(room - rest * length, first + filled, 1)
            if open_bins > filled + (rest > 0):
                bins.add(room, first + filled + (rest > 0), open_bins - filled - (rest > 0))
            rank += filled * fit + rest
            left -= filled * fit + rest
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def _pieces(path: str, capacity: int, separator: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(path).encode, TaskContext.get().partitionId(), {}
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = encode(batch.column("text"))
                out = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", *["ids"] * with_ids)}
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(separator)).astype("<u4")
                    first = len(own) % capacity or capacity
                    for k, end in enumerate(range(first, len(own) + 1, capacity)):
                        part = own[max(0, end - capacity) if k else 0 : end]
                        n = len(part)
                        rank = seen[n] = seen.get(n, -1) + 1
                        row = (doc_id, k, end - n, n, zlib.crc32(part.tobytes()), task, rank, *[part] * with_ids)
                        for name, value in zip(out, row):
                            out[name].append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return cut


def pack(docs: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack the texts of ``docs`` into as few sequences of ``capacity`` tokens as best fit decreasing finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids on demand. A document
    is its ids and the separator, so null and empty texts are one separator. Longer documents are cut from the end,
    so only the first piece may be short. A null doc_id stays null, repeated rows are packed each, other columns
    are not looked at, and an empty table gives no rows.
    """
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = stage(source.mapInArrow(_pieces(path or vocabulary(), capacity, separator, with_ids), fields), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = best_fit_plan(counts, capacity)
    keys = plan[:, 0] * _RANKS + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(n).to_numpy() for n in ("length", "rank"))
            run = plan[np.searchsorted(keys, length * _RANKS + rank, "right") - 1]
            nth = rank - run[:, 1]
            placed = [pa.array(run[:, 2] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * length)]
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.record_batch([*(b.column(n) for n in names), *placed], names=[*names, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("base") + F.col("rank")).alias("rank")
    )
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long")
