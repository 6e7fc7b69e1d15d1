"""Near-duplicate vectors by spherical-cap filters.

Filters are the words of a random product code: the coordinates, in an order drawn at random, are cut into a few blocks,
each with a codebook of random unit vectors; a filter takes one from each block. There are a few such codes. A vector is
decoded to all filters whose inner product with it exceeds a threshold, found by walking sorted partial sums, not by
trying all of them. Vectors that share a filter (and the label) meet in a bucket:

1. Each vector is compared with the smallest one of each of its buckets; the smallest that it links with is its leader.
   Vectors with one leader are a group with a radius; a vector without a leader leads itself.
2. Groups that share a filter are a pair if the angle between their leaders allows a link, given both radii. A sketch of
   128 signs is compared first, so most pairs are never rows.
3. The members of each pair of groups, and of each group, are compared in double precision, once, in blocks of bounded
   size. A block yields numbers of links and, per vector, one edge to its component, so no link is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import components
from foliant.llm.staging import stage

COSINE = 0.98
ANGLE = float(np.arccos(COSINE))
CODES = 5  # independent codes: a pair that one code misses is found by another
FILTERS = 12  # of each code that a vector exceeds, on average
LEAST = 8  # a vector that exceeds fewer gets a lower threshold, at which it exceeds so many
PER_FILTER = 24  # vectors that a filter should hold; sets the size of the code
SIGNS = 128  # bits of a sketch
SLACK = 22  # bits by which a sketch may differ beyond its mean: five standard deviations at least
MEET = 256  # groups of a bucket, per side, that meet in one task at a time
BLOCK = 2048  # members of a group, per side, that meet in one task at a time
SEED = 20240229


class Code:
    """A random product code for vectors of one dimension."""

    def __init__(self, dim: int, vectors: int, number: int):
        rng = np.random.default_rng([SEED, dim, number])
        self.blocks = [b for b in np.array_split(rng.permutation(dim), max(1, min(4, dim // 8)))]
        wanted = max(32.0, vectors * FILTERS / PER_FILTER)
        self.size = int(np.clip(np.ceil(wanted ** (1 / len(self.blocks))), 4, 256))
        self.books = []
        for b in self.blocks:
            book = rng.standard_normal((self.size, len(b)))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / np.sqrt(len(self.blocks)))
        share = min(0.9, FILTERS / self.size ** len(self.blocks))
        self.base = number * self.size ** len(self.blocks)  # where the numbers of its filters begin
        self.threshold = -NormalDist().inv_cdf(share) / np.sqrt(dim)

    def decode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``v`` (unit vectors) and numbers of the filters that they exceed."""
        sums = [v[:, b] @ book.T for book, b in zip(self.books, self.blocks)]
        joint = lambda x, y: (x[:, :, None] + y[:, None, :]).reshape(len(v), -1)
        left = joint(*sums[:2]) if len(sums) > 2 else sums[0]
        rest = sums[2:] if len(sums) > 2 else sums[1:]
        right = np.zeros((len(v), 1)) if not rest else rest[0] if len(rest) == 1 else joint(*rest)
        by_left, by_right = np.argsort(-left, axis=1), np.argsort(-right, axis=1)
        left, right = np.take_along_axis(left, by_left, 1), np.take_along_axis(right, by_right, 1)
        # The largest sums stand where few pairs of ranks are both smaller.
        ranks = [(i, j) for i in range(min(LEAST, left.shape[1])) for j in range(min(LEAST, right.shape[1])) if (i + 1) * (j + 1) <= LEAST]
        best = np.sort(left[:, [i for i, _ in ranks]] + right[:, [j for _, j in ranks]], axis=1)
        threshold = np.minimum(self.threshold, best[:, -min(LEAST, len(ranks))])
        rows, found, width = [], [], left.shape[1]
        for j in range(right.shape[1]):
            row, i = np.nonzero(left[:, :width] + right[:, j, None] >= threshold[:, None])
            if not len(row):
                break
            width = i.max() + 1  # a smaller right sum needs a left sum at least as large
            rows.append(row)
            found.append(self.base + by_left[row, i] * right.shape[1] + by_right[row, j])
        return np.concatenate(rows), np.concatenate(found)


@lru_cache(maxsize=8)
def _codes(dim: int, vectors: int) -> list[Code]:
    return [Code(dim, vectors, k) for k in range(CODES)]


@lru_cache(maxsize=8)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, CODES]).standard_normal((dim, SIGNS))


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that can link, as bytes of doubles; null for the others."""
    for b in batches:
        out = []
        for v, label in zip(b.column("embedding").to_pylist(), b.column("label").to_pylist()):
            ok = v is not None and label is not None and None not in v and len(v) > 0
            x = np.array(v, np.float64) if ok else np.zeros(0)
            ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
            out.append(x.tobytes() if ok else None)
        yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "vector"])


def _units(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, each at length one."""
    v = np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _filters(vectors: int):
    names = ["node", "label", "width", "filter", "sketch_a", "sketch_b"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, label, width = (b.column(n).to_numpy() for n in ("node", "label", "width"))
            for w in np.unique(width).tolist():
                codes = _codes(w // 8, vectors)
                step = max(1, (1 << 20) // codes[0].size ** 2)
                at = np.flatnonzero(width == w)
                for lo in range(0, len(at), step):
                    some = at[lo : lo + step]
                    v = _units(b.column("vector").take(pa.array(some)))
                    sketch = np.packbits(v @ _planes(w // 8) > 0, axis=1).view(np.int64)
                    for code in codes:
                        row, found = code.decode(v)
                        k = some[row]
                        yield pa.record_batch([pa.array(c) for c in (node[k], label[k], width[k], found, sketch[row, 0], sketch[row, 1])], names=names)

    return rows


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Angles of pairs that may be of different lengths from batch row to batch row."""
    for b in batches:
        width, out = np.array([len(x) for x in b.column("left").to_pylist()], np.int64), np.zeros(b.num_rows)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            x, y = (_units(b.column(n).take(pa.array(at))) for n in ("left", "right"))
            out[at] = np.arccos(np.clip((x * y).sum(axis=1), -1, 1))
        yield pa.record_batch([b.column("a"), b.column("b"), pa.array(out)], names=["a", "b", "angle"])


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks, and where a block begins. Rows come sorted by the keys; a block may span batches."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for key in keys:
            new[1:] |= np.diff(table.column(key).to_numpy()) != 0
        return np.flatnonzero(new)

    for b in batches:
        if b.num_rows:
            held.append(b)
            table = pa.Table.from_batches(held)
            last = int(starts(table)[-1])
            if last:
                done = table.slice(0, last)
                yield done, starts(done)
                held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups in each block whose sketches differ by few enough bits for the angle that their radii allow."""
    for table, starts in _whole(batches, ["block"]):
        group, radius, side = (table.column(n).to_numpy() for n in ("group", "radius", "side"))
        a, b = (table.column(n).to_numpy().view(np.uint64) for n in ("sketch_a", "sketch_b"))
        ends = np.repeat(np.append(starts[1:], len(group)), np.diff(np.append(starts, len(group))))
        rows, shift = np.arange(len(group)), 0
        while len(rows):
            shift += 1
            rows = rows[rows + shift < ends[rows]]
            other = rows + shift
            bits = np.bitwise_count(a[rows] ^ a[other]).astype(int) + np.bitwise_count(b[rows] ^ b[other])
            near = bits <= SIGNS / np.pi * np.minimum(np.pi, ANGLE + radius[rows] + radius[other]) + SLACK
            near &= (side[rows] != side[other]) | (side[rows] == 0)
            x, y = group[rows[near]], group[other[near]]
            if len(x):
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per vector of a block: its links there, and the first vector of the block that it is joined with by links."""
    for table, starts in _whole(batches, ["block", "a", "b"]):
        node, copies, side = (table.column(n).to_numpy() for n in ("node", "copies", "side"))
        raw, out = table.column("vector").combine_chunks(), []
        for lo, hi in zip(starts, [*starts[1:], len(node)]):
            if hi - lo < 2:
                continue
            v, s, n = _units(raw.slice(lo, hi - lo)), side[lo:hi], hi - lo
            slices = [slice(k, k + 512) for k in range(0, n, 512)]
            near = np.empty((n, n), bool)
            for part in slices:
                near[part] = (v[part] @ v.T >= COSINE) & ((s[part, None] != s) | (s == 0))
            np.fill_diagonal(near, False)
            near |= near.T
            links = np.concatenate([near[part] @ copies[lo:hi] for part in slices])
            first, before = np.arange(n), None
            while before is None or (first != before).any():
                before = first
                first = np.concatenate([np.minimum(before[part], np.where(near[part], before, n).min(axis=1)) for part in slices])
            at = np.flatnonzero(links)
            out.append((node[lo + at], links[at], node[lo + first[at]]))
        columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64)] * 3
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["node", "links", "linked"])


def _chunked(rows: DataFrame, count: str, size: int, by: str) -> DataFrame:
    """Deal rows into chunks of about ``size`` (``count``: rows that meet) and pair every chunk with each, and with itself."""
    chunks = F.ceil(F.col(count) / size).cast("int")
    dealt = rows.withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64(by), chunks).cast("int")})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumn("side", F.when(F.col("chunk") < F.col("other"), 1).when(F.col("chunk") > F.col("other"), 2).otherwise(0))


def _group_pairs(keyed: DataFrame, groups: DataFrame, nodes: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of groups (a < b) that share a filter and whose leaders are near enough for a link of their members."""
    bucket = ["label", "width", "filter"]
    here = keyed.select("node", *bucket).join(groups.select("node", "group"), "node").select("group", *bucket).distinct()
    shared = here.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    radii = groups.groupBy("group").agg(F.max("angle").alias("radius"))
    leaders = radii.join(sketches, F.col("group") == F.col("node")).drop("node")
    meeting = _chunked(here.join(shared, bucket), "n", MEET, "group").join(leaders, "group")
    block = F.xxhash64(*bucket, F.least("chunk", "other"), F.greatest("chunk", "other"))
    meeting = meeting.select(block.alias("block"), "group", "radius", "sketch_a", "sketch_b", "side")
    met = meeting.repartition("block").sortWithinPartitions("block").mapInArrow(_meet, "a long, b long").distinct()
    side = lambda name, vector: nodes.select(F.col("node").alias(name), F.col("vector").alias(vector))
    both = met.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right")
    of = lambda name: radii.select(F.col("group").alias(name), F.col("radius").alias(f"radius_{name}"))
    measured = both.mapInArrow(_angles, "a long, b long, angle double").join(of("a"), "a").join(of("b"), "b")
    return measured.where(F.col("angle") <= F.col("radius_a") + F.col("radius_b") + ANGLE + 1e-6).select("a", "b")


def _found_links(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Numbers of links per node and what it is joined with, over all groups and pairs of groups, each compared once."""
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    rows = ["block", "a", "b", "node", "copies", "vector", "side"]
    own = _chunked(members.join(sizes.where("n > 1"), "group"), "n", BLOCK, "node")
    own = own.withColumns({"a": F.col("group"), "b": F.col("group"), "block": F.xxhash64("group", F.least("chunk", "other"), F.greatest("chunk", "other"))}).select(rows)
    chunks = lambda name: sizes.select(F.col("group").alias(name), F.ceil(F.col("n") / BLOCK).cast("int").alias(f"chunks_{name}"))
    units = pairs.join(chunks("a"), "a").join(chunks("b"), "b")

    def across(mine: str, other: str, side: int) -> DataFrame:
        held = units.join(members, F.col(mine) == F.col("group"))
        held = held.withColumn(mine + "_chunk", F.pmod(F.xxhash64("node"), F.col(f"chunks_{mine}")).cast("int"))
        held = held.withColumn(other + "_chunk", F.explode(F.sequence(F.lit(0), F.col(f"chunks_{other}") - 1)))
        return held.withColumns({"block": F.xxhash64("a", "b", "a_chunk", "b_chunk"), "side": F.lit(side)}).select(rows)

    blocks = own.unionByName(across("a", "b", 1)).unionByName(across("b", "a", 2))
    sorted_ = blocks.repartition("block").sortWithinPartitions("block", "a", "b")
    found = sorted_.mapInArrow(_links, "node long, links long, linked long")
    return found.groupBy("node", "linked").agg(F.sum("links").alias("links"))


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable) and kept.

    Rows link if their labels are equal and their cosine is 0.98 or more. Vectors that are null, empty or zero, that
    hold a null or non-finite component, or whose label or vec_id is null, link with nothing. Equal vectors of a label are one
    node and linked with each other. Vectors of different length never meet. Rows that share a vec_id are vectors
    of their own. Other columns are not looked at; an empty table gives no rows.
    """
    source = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    prepared = source.mapInArrow(_prepare, "vec_id long, label long, vector binary")
    rows = stage(prepared.withColumn("row", F.monotonically_increasing_id()), "vectors")
    usable = rows.where("vec_id is not null and vector is not null")
    nodes = usable.groupBy("label", "vector").agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = stage(nodes.withColumn("width", F.length("vector").cast("long")), "nodes")
    n = nodes.count()
    schema = "node long, label long, width long, filter long, sketch_a long, sketch_b long"
    keyed = stage(nodes.select("node", "label", "width", "vector").mapInArrow(_filters(n), schema), "filters")

    bucket = ["label", "width", "filter"]
    hubs = keyed.groupBy(*bucket).agg(F.min(F.struct("node", "sketch_a", "sketch_b")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("hub.sketch_a"))) + F.bit_count(F.col("sketch_b").bitwiseXOR(F.col("hub.sketch_b")))
    met = keyed.join(hubs, bucket).where((F.col("node") != F.col("hub.node")) & (bits <= SIGNS * ANGLE / np.pi + SLACK))
    met = met.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    side = lambda name, vector: nodes.select(F.col("node").alias(name), F.col("vector").alias(vector))
    met = met.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right")
    led = met.mapInArrow(_angles, "a long, b long, angle double").where(F.col("angle") <= ANGLE)
    led = led.groupBy("a").agg(F.min(F.struct("b", "angle")).alias("to"))
    joined = nodes.select("node", "copies", "vector").join(led, F.col("node") == F.col("a"), "left")
    members = stage(joined.select("node", "copies", "vector", F.coalesce("to.b", "node").alias("group"), F.coalesce("to.angle", F.lit(0.0)).alias("angle")), "groups")
    sketches = keyed.groupBy("node").agg(F.first("sketch_a").alias("sketch_a"), F.first("sketch_b").alias("sketch_b"))
    pairs = stage(_group_pairs(keyed, members.select("node", "group", "angle"), nodes, sketches), "pairs")
    found = stage(_found_links(members, pairs), "links")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joint = components(found.select(F.col("node").alias("a"), F.col("linked").alias("b")))
    placed = nodes.drop("width").join(joint, "node", "left").join(counts, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    per_node = placed.join(least, "component").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    all_ = rows.join(per_node, ["label", "vector"], "left")
    usable_row = F.col("vec_id").isNotNull()
    found_id = F.when(usable_row, F.coalesce("component_id", "vec_id"))
    return all_.select(
        "vec_id", F.when(usable_row, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        found_id.alias("component_id"), F.coalesce(F.col("vec_id") == found_id, F.lit(True)).alias("kept"),
    )
