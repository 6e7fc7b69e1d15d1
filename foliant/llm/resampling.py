"""Importance resampling: draw the documents whose word n-grams look most like those of a target.

1. Every text is cut into words and scanned once for the running CRCs of its prefixes; the CRC of each run of one or
   two words follows from two of them, and its bucket from the CRC. Tasks add up their own counts per bucket, so the
   counts of the corpus and of the target are ``BUCKETS`` numbers each, whatever the size of either.
2. A bucket's gain is the logarithm of its smoothed share in the target over that in the corpus. A document weighs the
   mean gain of its features. With Gumbel noise from its id added, the highest scores are a draw without replacement.
3. The draw is a sort: documents are dealt by ranges of (score, doc_id), numbered within a range, and the ranges' sizes
   give the rest, so no task sees more than its range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.prefixcrc import RunningCrc
from foliant.llm.staging import stage

BUCKETS = 10_000
WORDS = 2  # longest run of words that is a feature
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Bytes of text that are scanned at a time; a document may span scans.
SCAN = 1 << 22

# ASCII letters and digits stay, A-Z in lower case; what is not ASCII stays; the rest separates.
_SIGNS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_PLACE = 33  # bits that monotonically_increasing_id gives to the place within a partition


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs of bounded size; a run repeats the last words of the one before it, so no n-gram is lost."""
    tail: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + SCAN
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut if cut > at else text.find(b" ", end)  # a word longer than a scan stays whole
            end = len(text) if end < 0 else end
        found = text[at:end].split()
        if found:
            yield tail + found
            tail = (tail + found)[-(WORDS - 1) :]
        at = end


def buckets(text: bytes | None, n_buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of one or more words, repeats included."""
    n, out, known = 0, [], 0
    for words in _parts((text or b"").translate(_SIGNS)):
        crc = RunningCrc(words)
        new = len(words) - known  # the first ``known`` words were in the part before
        for size in range(1, WORDS + 1):
            first = np.arange(max(0, known - size + 1), len(words) - size + 1)
            out.append(crc.grams(first, size) % np.uint32(n_buckets))
        n += new
        known = min(WORDS - 1, len(words))
    return n, np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _count(n_buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                total += np.bincount(buckets(text, n_buckets)[1], minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return rows


def profile(docs: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. The driver sees ``n_buckets`` rows at most."""
    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_count(n_buckets), "bucket long, n long")
    out = np.zeros(n_buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's share in the target over that in the corpus, one added to each count."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    share = lambda s, t: (t + 1.0) * (all_corpus + n) / ((s + 1.0) * (all_target + n))
    return np.array([math.floor(1000 * math.log(share(float(s), float(t)))) for s, t in zip(corpus, target)], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """1000 times a Gumbel variable that depends on the id alone."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain: np.ndarray, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int | None]] = []
            for doc_id, text in zip(b.column("scored id").to_pylist(), b.column("scored text").to_pylist()):
                n_words, at = buckets(text, len(gain))
                weight = int(gain[at].sum()) // len(at) if len(at) else 0
                out.append((n_words, len(at), weight, None if doc_id is None else weight + noise(doc_id, seed)))
            added = [pa.array(column, pa.int64()) for column in zip(*out)] if out else [pa.array([], pa.int64())] * 4
            kept = [n for n in b.schema.names if n != "scored text"]
            yield pa.record_batch([*(b.column(n) for n in kept), *added], names=[*kept, "n_words", "n_features", "weight", "score"])

    return rows


RESULTS = ("n_words", "n_features", "weight", "score", "rank")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS,
    n_buckets: int = BUCKETS, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Per row of ``docs``: the columns ``keep`` (as doc_id and text, or others; none named like a result), n_words,
    n_features, weight, score and rank, all long.

    ``rank`` counts from 1 through the drawn documents: of the N with at least ``least_words`` words, floor(percent * N / 100)
    with the highest scores, ties to the smaller doc_id; it is null for the others. Null and empty texts have no feature and weight 0.
    A row without doc_id counts in the corpus, but has no noise, so no score, and is never drawn. Rows that repeat a
    doc_id are documents of their own with the same noise. An empty table gives no rows; an empty target gives gains
    from the corpus alone. Columns that are not kept are not looked at.
    """
    clashing = set(keep) & set(RESULTS)
    if clashing:
        raise ValueError(f"results would hide the columns {sorted(clashing)}")
    gain = gains(profile(docs, n_buckets), profile(target, n_buckets))
    kept = [F.col(f"`{c}`") for c in keep]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema)
    source = docs.select(
        *kept, F.col("doc_id").cast("long").alias("scored id"), F.col("text").cast("binary").alias("scored text")
    )
    weighed = source.mapInArrow(_weigh(gain, seed), f"{fields}, `scored id` long, n_words long, n_features long, weight long, score long")
    takes_part = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    scored = stage(weighed.withColumn("takes part", takes_part), "scored")
    order = [F.desc("takes part"), F.desc("score"), F.asc("scored id")]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = stage(dealt, "ordered").withColumn("part", F.shiftright("at", _PLACE))
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("takes part").alias("n_taking"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    bases = sizes.select(F.col("part").alias("in part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    draw = sizes.agg(F.coalesce(F.sum("n_taking"), F.lit(0)).alias("n")).first()["n"] * percent // 100
    rank = F.col("base") + F.col("at").bitwiseAND((1 << _PLACE) - 1) + 1
    return ordered.join(bases, F.col("part") == F.col("in part")).select(
        *kept, "n_words", "n_features", "weight", "score", F.when(F.col("takes part") & (rank <= draw), rank).alias("rank")
    )


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn documents with their texts, as (rank, doc_id, text)."""
    return resample(docs, target, percent, seed, keep=("doc_id", "text")).where("rank is not null").select("rank", "doc_id", "text")
