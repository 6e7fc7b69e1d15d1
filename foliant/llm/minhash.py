"""Near-duplicate documents by MinHash bands, with sequential Bayesian verification of the candidates.

1. Every document gets 128 minima of its set of word shingles, and a digest of the set. Equal sets are one class
   with one representative, so copies cost nothing from here on.
2. Representatives that agree on a band of four minima meet in a bucket. Each is a candidate with two of the smallest
   of its buckets: the one met most often, and the smallest of all. A pair of similarity 0.75 misses all 32 bands with
   a probability under 1e-5.
3. Candidates are verified in sequence: batches of minima are compared, and after each the pair is dropped if, by the
   posterior of its similarity, it reaches the threshold with a probability under ``MISS`` only. Survivors
   are confirmed on their full sets.
4. Where a bucket still holds documents of several components, its other pairs are looked at too: in blocks of
   bounded size, by the same sequential test inside the task. Documents with a survivor get their texts, and survivors
   are confirmed in the block, those that agree most first; pairs are never rows, and a block gives fewer links than it
   has documents. Pairs of one component need no look, as they change nothing; so the largest component of a bucket meets
   only the documents outside it.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import components
from foliant.llm.hashing import mix, shingles
from foliant.llm.staging import stage

WORDS = 5
SIMILAR = (75, 100)  # links: 100 * intersection >= 75 * union
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
BATCH = 16  # minima compared at a time
MISS = 1e-7  # posterior probability at which a candidate is given up
SET_BYTES = 64 << 20  # shingles that a task remembers while it confirms a block
BLOCK = 1024  # documents of a bucket that meet in one block: half a megabyte of minima

_seeds = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_XOR, _FACTOR = _seeds[:MINIMA, None], _seeds[MINIMA:, None] | np.uint64(1)


def minima(found: np.ndarray) -> np.ndarray:
    """For each of the hash functions the upper half of the least value over a set."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(found), 512):
        least = np.minimum(least, ((found[None, lo : lo + 512] ^ _XOR) * _FACTOR).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def least_matches(n: int) -> int:
    """The fewest matches among ``n`` minima at which similarity 0.75 is not yet given up.

    With a uniform prior the posterior of the similarity after m matches is Beta(m + 1, n - m + 1), and its mass
    above t is the probability that a Binomial(n + 1, t) is at most m.
    """
    t, mass, m = SIMILAR[0] / SIMILAR[1], 0.0, 0
    while True:
        mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if mass >= MISS:
            return m
        m += 1


def tested(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (rows of minima) survive all batches, and how many of their minima agree."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int32)
    for n in range(BATCH, MINIMA + 1, BATCH):
        matches += (left[alive, n - BATCH : n] == right[alive, n - BATCH : n]).sum(axis=1, dtype=np.int32)
        stays = matches >= least_matches(n)
        alive, matches = alive[stays], matches[stays]
    return alive, matches


def sequential(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return tested(left, right)[0]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, digest, signs = [], [], []
        for text in b.column("text").to_pylist():
            found = shingles(text or b"", WORDS)
            n.append(len(found))
            digest.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
            signs.append(minima(found).tobytes() if len(found) else None)
        yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set_md5", "minima"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, MINIMA)


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        alive = sequential(_matrix(b.column("left")), _matrix(b.column("right")))
        yield pa.record_batch([b.column("a").take(pa.array(alive)), b.column("b").take(pa.array(alive))], names=["a", "b"])


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(left) + len(right) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    recent: OrderedDict[int, np.ndarray] = OrderedDict()

    def found(doc_id: int, text: bytes) -> np.ndarray:
        if doc_id not in recent:
            recent[doc_id] = shingles(text, WORDS)
            if len(recent) > 8:
                recent.popitem(last=False)
        return recent[doc_id]

    for b in batches:
        keep = [similar(found(x, s), shingles(t, WORDS)) for x, s, t in zip(*(b.column(n).to_pylist() for n in ("a", "left", "right")))]
        mask = pa.array(keep, pa.bool_())
        yield pa.record_batch([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs whose full sets are similar. Sorted by ``a``, whose set is computed once per run."""
    side = lambda name, text: texts.select(F.col("doc_id").alias(name), F.col("text").alias(text))
    both = pairs.join(side("b", "right"), "b").join(side("a", "left"), "a").select("a", "b", "left", "right")
    return both.mapInArrow(_confirm, "a long, b long").distinct()


_BIT = np.int64(1) << np.arange(BANDS, dtype=np.int64)


def _bands(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of rows of minima the bands on which it agrees, as bits."""
    return (left == right).reshape(-1, BANDS, ROWS).all(axis=2) @ _BIT


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block at a time. Rows come sorted by block; a block may span batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        blocks = b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and hi > lo and held[0].column("block")[0].as_py() != blocks[lo]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(rows: pa.Table, signs: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs across components that survive the sequential test, and how many minima agree.

    A pair that agrees on several bands is taken where the first of them is one of ``bands``, so in one block.
    """
    parts, sizes, sides = (rows.column(n).to_numpy() for n in ("component", "n_shingles", "side"))
    found = []
    for lo in range(0, len(signs), 32):  # some rows against all later ones
        i, j = np.nonzero(np.arange(lo, min(lo + 32, len(signs)))[:, None] < np.arange(len(signs))[None, :])
        i += lo
        # In a block of two chunks only pairs across the chunks are new.
        ok = (parts[i] != parts[j]) & ((sides[i] != sides[j]) | (sides[i] == 0))
        ok &= SIMILAR[1] * np.minimum(sizes[i], sizes[j]) >= SIMILAR[0] * np.maximum(sizes[i], sizes[j])
        i, j = i[ok], j[ok]
        alive, matches = tested(signs[i], signs[j])
        i, j = i[alive], j[alive]
        agreed = _bands(signs[i], signs[j])
        own = (agreed & -agreed & bands) != 0
        found.append((i[own], j[own], matches[own]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block that have a surviving pair, with the bands that the whole block agrees on."""
    for rows in _runs(batches):
        signs = _matrix(rows.column("minima"))
        # The block's own band is among them; all bands, should two different bands have one hash.
        bands = int(np.bitwise_and.reduce(_bands(signs, signs[:1]))) or int(_BIT.sum())
        i, j, _ = _pairs(rows, signs, bands)
        if len(i):
            out = rows.take(pa.array(np.unique(np.concatenate([i, j]))))
            yield from out.append_column("bands", pa.array(np.full(len(out), bands))).to_batches()


class _Sets:
    """Shingles of the texts of a block; those used last are remembered, up to SET_BYTES."""

    def __init__(self, texts: pa.ChunkedArray):
        self.texts, self.known, self.size = texts, OrderedDict(), 0

    def __getitem__(self, k: int) -> np.ndarray:
        if k in self.known:
            self.known.move_to_end(k)
        else:
            self.known[k] = shingles(self.texts[k].as_py(), WORDS)
            self.size += self.known[k].nbytes
            while self.size > SET_BYTES and len(self.known) > 2:
                self.size -= self.known.popitem(last=False)[1].nbytes
        return self.known[k]


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links of each block that join components: fewer than it has documents.

    Pairs are confirmed on full sets, those that agree most first; a pair whose documents were joined before is skipped.
    """
    for rows in _runs(batches):
        signs, ids = _matrix(rows.column("minima")), rows.column("doc_id").to_numpy()
        i, j, matches = _pairs(rows, signs, rows.column("bands")[0].as_py())
        order = np.argsort(-matches, kind="stable")
        i, j = i[order], j[order]
        part = np.unique(rows.column("component").to_numpy(), return_inverse=True)[1]
        sets, a, b = _Sets(rows.column("text")), [], []
        while len(i):
            for x, y in zip(i[:512].tolist(), j[:512].tolist()):
                if part[x] != part[y] and similar(sets[x], sets[y]):
                    part[part == part[y]] = part[x]
                    a.append(min(ids[x], ids[y]))
                    b.append(max(ids[x], ids[y]))
            i, j = i[512:], j[512:]
            open_ = part[i] != part[j]
            i, j = i[open_], j[open_]
        if a:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept.

    Null texts and texts without words have no shingles and no links. A text of fewer than five words is one shingle.
    A row without doc_id links with nothing: its component is null and it is kept. Rows that share a doc_id are
    taken as versions of one document. Other columns are not looked at; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    signed = source.mapInArrow(_sign, "doc_id long, n_shingles long, set_md5 binary, minima binary")
    signed = stage(signed.withColumn("row", F.monotonically_increasing_id()), "minima")
    n_docs = signed.count()
    linkable = signed.where("doc_id is not null and set_md5 is not null")
    classes = linkable.groupBy("set_md5").agg(F.min(F.struct("doc_id", "row")).alias("head"))
    heads = stage(signed.join(classes.select("head.row"), "row", "left_semi").select("doc_id", "n_shingles", "minima"), "heads", rows=n_docs)
    band = lambda i: F.xxhash64(i, F.substring("minima", i * 4 * ROWS + 1, F.lit(4 * ROWS)))
    in_bands = heads.select("doc_id", "n_shingles", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("band"))
    buckets = stage(
        in_bands.groupBy("band")
        .agg(F.min(F.struct("doc_id", "n_shingles")).alias("hub"), F.count(F.lit(1)).alias("n"))
        .where("n > 1"),
        "buckets",
        rows=n_docs,
    )
    members = stage(in_bands.join(buckets, "band").select("band", "doc_id", "n_shingles", "hub"), "members", rows=n_docs)
    sizes_fit = F.expr(f"{SIMILAR[1]} * least(n_shingles, hub.n_shingles) >= {SIMILAR[0]} * greatest(n_shingles, hub.n_shingles)")
    met = members.where(sizes_fit & (F.col("doc_id") != F.col("hub.doc_id"))).groupBy(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b"))
    met = met.agg(F.count(F.lit(1)).alias("times")).groupBy("b").agg(F.min("a").alias("least"), F.min(F.struct(-F.col("times"), "a"))["a"].alias("often"))
    stars = met.select(F.explode(F.array_distinct(F.array("least", "often"))).alias("a"), "b")
    signs = lambda name, sign: heads.select(F.col("doc_id").alias(name), F.col("minima").alias(sign))
    candidates = stars.join(signs("b", "right"), "b").join(signs("a", "left"), "a").select("a", "b", "left", "right")
    texts = source.where("doc_id is not null")
    links = stage(confirmed(candidates.mapInArrow(_survivors, "a long, b long").distinct(), texts), "links", rows=n_docs)
    labels = stage(components(links), "labels", rows=n_docs)

    others = members.join(labels, F.col("doc_id") == F.col("node"), "left")
    others = others.select("band", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    parts = others.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n")).where("n > main.n")
    in_main = F.col("component") == F.col("main.component")
    size = lambda n: F.ceil(n / (BLOCK // 2)).cast("int")
    others = others.join(split, "band").withColumns({"mains": size(F.col("main.n")), "rests": size(F.col("n") - F.col("main.n"))})
    # Chunks of the main component come first. They meet the rest only, which meets all.
    chunk = F.when(in_main, F.pmod(F.xxhash64("doc_id"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("doc_id"), "rests")).cast("int")
    met_chunks = F.sequence(F.when(in_main, F.col("mains")).otherwise(0), F.col("mains") + F.col("rests") - 1)
    others = others.withColumn("chunk", chunk).withColumn("other", F.explode(met_chunks))
    blocks = others.select(
        F.xxhash64("band", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("block"), "doc_id", "n_shingles", "component",
        F.when(F.col("chunk") < F.col("other"), 1).when(F.col("chunk") > F.col("other"), 2).otherwise(0).alias("side"),
    ).join(heads.select("doc_id", "minima"), "doc_id")
    by_block = lambda rows: rows.repartition("block").sortWithinPartitions("block")
    open_ = by_block(blocks.select("block", "doc_id", "n_shingles", "component", "side", "minima"))
    open_ = open_.mapInArrow(_open_blocks, "block long, doc_id long, n_shingles long, component long, side int, minima binary, bands long")
    more = by_block(open_.join(texts, "doc_id")).mapInArrow(_join_blocks, "a long, b long")
    more = stage(more.distinct(), "links", rows=n_docs)
    final = components(links.unionByName(more)) if more.limit(1).count() else labels

    heads_of = classes.select("set_md5", F.col("head.doc_id").alias("first"))
    first = signed.join(heads_of, "set_md5", "left").join(final, F.col("first") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id"))
    return first.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates, unchanged: of each component the row with the smallest doc_id stays.

    Rows are compared by their own texts, whatever their doc_id: rows that repeat and rows that share an id are
    copies of each other only if their texts are alike. Rows without doc_id come after all others. Null texts and
    texts without words stay.
    """
    rows = stage(docs.select("*", F.monotonically_increasing_id().alias("minhash row")), "numbered")
    found = near_duplicates(rows.select(F.col("minhash row").alias("doc_id"), "text")).select(F.col("doc_id").alias("minhash row"), F.col("component_id").alias("component"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("minhash row").alias("row"))
    first = rows.select("doc_id", "minhash row").join(found, "minhash row").groupBy("component").agg(F.min(order)["row"].alias("minhash row"))
    return rows.join(first, "minhash row", "left_semi").drop("minhash row")
