"""Shards of near equal bytes by histogram sort.

Rows are ordered by a 192-bit key: a digest of the text, one of the doc_id and one of the row's number in the staged
table, so equal texts lie side by side and rows that repeat can still be parted.
A splitter is searched for without moving rows: every round the tasks count exact bytes and rows below a list of
probes, and each splitter's bracket shrinks to the probes around its target, until one lies within the tolerance
or no row is left between. Then rows are exchanged once, by ranges that are as fine as wanted: a shard may be far
larger than a task. A group of equal texts stays whole unless a border inside it is needed to keep sizes equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.staging import stage

SHARDS = 24
ROW_BYTES = 8  # what a row costs besides its text
TOLERANCE = 0.001  # of a shard's bytes
GROUP_TOLERANCE = 0.02  # the same for a border that keeps equal texts together
RANGE_BYTES = 256 << 20  # what one task sorts after the exchange
PROBES = 32
_WIDTH = 24  # bytes of a key
_KEYS = 1 << 8 * _WIDTH
_GROUP = 1 << 128


def _digest(c: Column) -> Column:
    return F.lpad(F.hex(F.xxhash64(c)), 16, "0")


def key(text: Column, doc_id: Column, row: Column) -> Column:
    return F.unhex(F.concat(F.substring(F.md5(text), 1, 16), _digest(doc_id), _digest(row)))


def _as_bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(_WIDTH, "big") for k in keys], f"S{_WIDTH}")


def _interval(batch: pa.RecordBatch, probes: np.ndarray) -> np.ndarray:
    """How many probes are at or below each row's key."""
    return np.searchsorted(probes, np.frombuffer(b"".join(batch.column("shard key").to_pylist()), f"S{_WIDTH}"), "right")


def _histogram(keyed: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe."""
    borders = _as_bytes(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(borders) + 1, np.int64), np.zeros(len(borders) + 1, np.int64)
        for b in batches:
            at = _interval(b, borders)
            np.add.at(size, at, b.column("size").to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        hit = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(hit), pa.array(size[hit]), pa.array(rows[hit])], names=["at", "size", "n"])

    found = keyed.select("shard key", "size").mapInArrow(count, "at long, size long, n long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    size, rows = np.zeros(len(borders) + 1, np.int64), np.zeros(len(borders) + 1, np.int64)
    for r in found.collect():  # a row per probe at most
        size[r["at"]], rows[r["at"]] = r["size"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


@dataclass
class Splitter:
    """Search for the key with ``target`` bytes below it. lo and hi: (key, bytes below, rows below)."""

    target: float
    lo: tuple[int, int, int]
    hi: tuple[int, int, int]
    done: bool = False

    def nearest(self) -> tuple[int, int, int]:
        return min(self.lo, self.hi, key=lambda x: abs(x[1] - self.target))

    def probes(self) -> list[int]:
        lo, hi = self.lo[0], self.hi[0]
        step = _GROUP if hi - lo > _GROUP else 1  # between groups of equal texts first
        places = {lo + (hi - lo) * i // (PROBES + 1) // step * step for i in range(1, PROBES + 1)}
        return [p for p in places | {-(-(lo + 1) // step) * step} if lo < p < hi]

    def narrow(self, points: list[tuple[int, int, int]], tolerance: float, group_tolerance: float) -> None:
        for p in points:
            if self.lo[0] < p[0] and p[1] <= self.target:
                self.lo = p
            elif p[1] > self.target and p[0] < self.hi[0]:
                self.hi = p
        off = abs(self.nearest()[1] - self.target)
        one_group = self.lo[0] % _GROUP == self.hi[0] % _GROUP == 0 and self.hi[0] - self.lo[0] == _GROUP
        self.done = off <= tolerance or self.hi[2] - self.lo[2] <= 1 or self.hi[0] - self.lo[0] <= 1 or one_group and off <= group_tolerance


def find_splitters(keyed: DataFrame, targets: list[float], total: tuple[int, int], tolerances: list[float], group_tolerances: list[float]) -> list[tuple[int, int, int]]:
    """For each target the chosen key, with the bytes and rows below it."""
    searches = [Splitter(t, (0, 0, 0), (_KEYS, *total)) for t in targets]
    while open_ := [s for s in searches if not s.done]:
        probes = sorted({p for s in open_ for p in s.probes()})
        points = list(zip(probes, *(x.tolist() for x in _histogram(keyed, probes)))) if probes else []
        keys = np.array([p[0] for p in points], object)
        for s, near, group in zip(searches, tolerances, group_tolerances):
            if not s.done:
                lo, hi = np.searchsorted(keys, s.lo[0], "right"), np.searchsorted(keys, s.hi[0], "left")
                s.narrow(points[lo:hi], near, group)
    return [s.nearest() for s in searches]


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, range_bytes: int = RANGE_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The rows with size, shard and slot (gapless from 0 in each shard), and their other columns.

    ``keep`` names the columns wanted besides; None keeps all but those called like the results. Null texts count no
    bytes and lie with the empty ones. Rows that repeat are dealt like any others. An empty table gives
    no rows; with fewer rows than shards some shards stay empty.
    """
    own = {"size", "shard", "slot"}
    names = [f"`{c}`" for c in docs.columns if c.lower() not in own] if keep is None else keep
    text = F.coalesce(F.col("text"), F.lit(""))
    place = key(text, F.coalesce(F.col("doc_id"), F.lit(0)), F.monotonically_increasing_id())
    keyed = stage(docs.select(*names, (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), place.alias("shard key")), "keyed")
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, -(-total["size"] // (shards * range_bytes)))  # ranges to a shard
    share = total["size"] / shards
    places = range(1, shards * parts)
    tight = lambda k, x: x * share if k % parts == 0 else share / parts / 4
    found = find_splitters(
        keyed, [share * k / parts for k in places], (total["size"], total["n"]), [tight(k, TOLERANCE) for k in places], [tight(k, GROUP_TOLERANCE) for k in places]
    ) if total["n"] else []
    borders = _as_bytes([s[0] for s in found]) if all(s[0] < _KEYS for s in found) else _as_bytes([min(s[0], _KEYS - 1) for s in found])
    below = np.array([0, *(s[2] for s in found)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _interval(b, borders)
            shard = at // parts
            new = [pa.array(at.astype(np.int32)), pa.array(shard.astype(np.int32)), pa.array(below[at] - below[shard * parts])]
            yield pa.record_batch([*b.columns, *new], names=[*b.schema.names, "shard range", "shard", "first slot"])

    dealt = keyed.mapInArrow(deal, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", `shard range` int, shard int, `first slot` long")
    nth = F.row_number().over(Window.partitionBy("shard range").orderBy("shard key"))
    return dealt.withColumn("slot", F.col("first slot") + nth - 1).select(*names, "size", "shard", "slot")
