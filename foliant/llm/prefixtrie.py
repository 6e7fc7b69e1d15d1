"""The trie of all conversation prefixes, from sorted conversations and range minima over their common prefixes.

1. A turn is a 16-byte digest and a conversation the string of its turns' digests. Conversations are sorted by that string in
   ranges, so those below a trie node are neighbours; each knows how many first turns it shares with the one before.
2. In a range, a sparse table over these numbers gives the minimum of any stretch in two look-ups. Each prefix of each
   conversation is a candidate; it binary-searches its left extent, and where it is the leftmost of its node, its right
   extent, independently of all others. What a node needs of its members are differences of running sums.
3. A node that goes on in the next range has a row in each; these are added up by the digest of the prefix.

A range holds ``RANGE`` turns or so, whatever the corpus. A conversation is one row of some 40 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.staging import stage

RANGE = 200_000  # turns and conversations of a range
FAMILY = 20  # conversations that take first turns from the same one
TAKEN = 4  # they take fewer than so many
WORD = r"[^\x20\x09-\x0D]+"
_DIGEST = 16
_PLACE = 33  # bits that monotonically_increasing_id gives to the place within a partition
_NO_TURNS = "array<struct<digest: string, n_words: int>>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: an array of (digest, n_words).

    Turns are ordered by number, null first, and turns of one number by digest. A null role or text is empty. Rows without
    conv_id belong to no conversation. Repeated rows are repeated turns. Other columns are not looked at.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("n_words"))
    known = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), turn.alias("t"))
    grouped = known.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return grouped.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["n_words"].alias("n_words"))).alias("turns"))


def _first(turns: Column, n: Column | int) -> Column:
    return F.slice(turns, 1, F.least(F.lit(n), F.size(turns)))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation with its first turns replaced by those of the first one of its family: h of them, by its id's CRC."""
    heads = turns.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), _first(F.col("turns"), TAKEN - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN).cast("int")
    both = turns.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "family", "left")
    head = F.coalesce(_first(F.col("head"), h), F.array().cast(_NO_TURNS))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return both.select("conv_id", F.concat(head, own).alias("turns"))


# --- one range ------------------------------------------------------------------------


class SparseTable:
    """Minima of all stretches of a row of numbers whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half, below = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values[lo..hi], both included."""
        out = np.empty(len(lo), self.levels[0].dtype)
        level = np.frexp(hi - lo + 1)[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << k) + 1])
        return out

    def leftmost(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest l such that values[l+1..at] are all at least ``bound``: a binary search by range minima."""
        l = at.copy()
        for k in reversed(range(len(self.levels))):
            step = 1 << k
            fits = l >= step
            fits[fits] = self.levels[k][l[fits] - step + 1] >= bound[fits]
            l[fits] -= step
        return l

    def rightmost(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest r such that values[at+1..r] are all at least ``bound``."""
        n, r = len(self.levels[0]), at.copy()
        for k in reversed(range(len(self.levels))):
            step = 1 << k
            fits = r + step < n
            fits[fits] = self.levels[k][r[fits] + 1] >= bound[fits]
            r[fits] += step
        return r


def shared_turns(a: bytes, b: bytes) -> int:
    """How many first turns two conversations have in common."""
    n = min(len(a), len(b)) // _DIGEST
    x, y = (np.frombuffer(s, np.uint64, 2 * n).reshape(n, 2) for s in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


def _neighbours(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Shared first turns of each conversation with the one before (the first has 0)."""
    out = np.zeros(len(size), np.int64)
    alive, depth = np.arange(1, len(size)), 0
    while len(alive):
        alive = alive[np.minimum(size[alive], size[alive - 1]) > depth]
        alive = alive[(flat[begin[alive] + depth] == flat[begin[alive - 1] + depth]).all(axis=1)]
        depth += 1
        out[alive] = depth
    return out


def _sums(values: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(values))


def range_nodes(conv_id: np.ndarray, paths: list[bytes], n_words: np.ndarray, before: int, after: int) -> dict[str, list | np.ndarray]:
    """The trie nodes of one sorted range. ``n_words`` has all turns in a row; ``before`` and ``after`` are the first turns that the
    range's ends share with the neighbouring ranges, -1 where there is none."""
    n = len(paths)
    size = np.array([len(p) // _DIGEST for p in paths], np.int64)
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    lcp = _neighbours(flat, begin, size)
    lcp[0] = before
    following = np.append(lcp[1:], after)
    running = _sums(n_words)  # words before each turn of the range

    def words(i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the first ``depth`` turns of conversation i."""
        return running[begin[i] + np.maximum(depth, 0)] - running[begin[i]]

    every = np.arange(n)
    total = words(every, size)
    totals, new_words = _sums(total), _sums(total - words(every, lcp))
    leaves = _sums(following < size)
    starts_child = np.flatnonzero(lcp < size)
    child_keys = np.sort(lcp[starts_child] * n + starts_child)

    table = SparseTable(lcp)
    at = np.repeat(every, size + 1)
    depth = np.arange(len(at)) - np.repeat(begin + every, size + 1)
    first = table.leftmost(at, depth) == at
    l, d = at[first], depth[first]
    r = table.rightmost(l, d)

    members = r - l + 1
    gross = totals[r + 1] - totals[l] - members * words(l, d - 1)
    distinct = new_words[r + 1] - new_words[l + 1] + total[l] - words(l, np.maximum(d - 1, lcp[l]))
    children = np.searchsorted(child_keys, d * n + r, "right") - np.searchsorted(child_keys, d * n + l, "right")
    children = children + ((size[l] > d) & (lcp[l] <= d))
    is_open = ((l == 0) & (before >= d)) | ((r == n - 1) & (after >= d))

    ends_run = np.append(np.flatnonzero((lcp != size) | (np.append(-1, size[:-1]) != size) | (every == 0)), n)  # where equal ones begin
    keys, parents, ends = [], [], []
    last, at_key, digest = -1, b"", hashlib.md5()
    for i, k in zip(l.tolist(), d.tolist()):
        if i != last:
            digest = hashlib.md5(paths[i][: _DIGEST * max(0, k - 1)])
            last, at_key = i, digest.digest()
        if k:
            digest.update(paths[i][_DIGEST * (k - 1) : _DIGEST * k])
        parents.append(at_key if k else None)
        at_key = digest.digest()
        keys.append(at_key)
        if size[i] == k:
            stop = ends_run[np.searchsorted(ends_run, i, "right")]
            ends.append(",".join(map(str, conv_id[i:stop].tolist())).encode())
        else:
            ends.append(None)
    closed_digest = [None if o else hashlib.sha256(e or b"").hexdigest() for o, e in zip(is_open.tolist(), ends)]
    return {
        "key": keys, "parent_key": parents, "depth": d, "conv_id": SparseTable(conv_id).least(l, r), "n_convs": members, "n_children": children,
        "n_leaves": leaves[r + 1] - leaves[l], "saved_tokens": gross - distinct, "ends_sha256": closed_digest,
        "ends": [e if o else None for o, e in zip(is_open.tolist(), ends)],
    }


_FIELDS = {
    "key": pa.binary(), "parent_key": pa.binary(), "depth": pa.int64(), "conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "ends": pa.binary(), "part": pa.int64(),
}
_SCHEMA = (
    "key binary, parent_key binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long,"
    " ends_sha256 string, ends binary, part long"
)


def _range(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("at")
    words = rows.column("n_words").combine_chunks()
    n_words = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = {c: rows.column(c)[0].as_py() for c in ("part", "before", "after")}
    found = range_nodes(rows.column("conv_id").to_numpy(), rows.column("path").to_pylist(), n_words, numbers["before"], numbers["after"])
    found["part"] = np.full(len(found["depth"]), numbers["part"])
    return pa.table({name: pa.array(found[name], kind) for name, kind in _FIELDS.items()})


# --- all ranges -----------------------------------------------------------------------


def _border_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [-1 if x is None else shared_turns(x, y) for x, y in zip(b.column("earlier").to_pylist(), b.column("first").to_pylist())]
        yield pa.record_batch([b.column("part"), pa.array(n, pa.int64())], names=["part", "before"])


def _borders(ranges: DataFrame) -> DataFrame:
    """part, before, after: the turns that a range's first and last conversation share with their neighbours. A row per range."""
    by_part = Window.orderBy("part")
    ends = ranges.groupBy("part").agg(F.min_by("path", "at").alias("first"), F.max_by("path", "at").alias("last"))
    pairs = ends.select("part", "first", F.lag("last").over(by_part).alias("earlier"))
    before = pairs.mapInArrow(_border_turns, "part long, before long")
    return before.select("part", "before", F.coalesce(F.lead("before").over(by_part), F.lit(-1)).alias("after"))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of each key, comma-joined, in the order in which they come. One chunk is held at a time."""
    key, digest = None, hashlib.sha256()
    for b in batches:
        done: list[tuple[bytes, str]] = []
        for k, chunk in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(chunk)
        yield pa.record_batch([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["key", "digest"])
    if key is not None:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "digest"])


def trie(paths: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations (``conv_id``, unique, and ``turns``, an array of digest and n_words).

    Per node, long but for the digests: key and parent_key (digests of the prefix), conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. An empty table gives no rows.
    """
    coded = paths.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["n_words"]).alias("n_words"),
    )
    coded = stage(coded, "rebuilt")
    size = coded.agg(F.coalesce(F.sum(F.size("n_words") + 1), F.lit(0)).alias("n")).first()["n"]
    dealt = coded.repartitionByRange(-(-size // RANGE) or 1, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    ranges = stage(dealt.withColumn("at", F.monotonically_increasing_id()), "ranges").withColumn("part", F.shiftright("at", _PLACE))
    found = stage(ranges.join(_borders(ranges), "part").groupBy("part").applyInArrow(_range, _SCHEMA), "nodes")
    nodes = found.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("in_range"),
    )
    chunks = found.where("ends is not null").select("key", "part", "ends")
    ends = chunks.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_hash_ends, "key binary, digest string")
    whole = nodes.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("in_range", "digest", F.sha2(F.lit(""), 256)))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents, "parent_key", "left").select(
        "key", "parent_key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(rebuilt(ordered_turns(conversations)))
