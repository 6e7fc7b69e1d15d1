"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

FTRL keeps a rate per coordinate and an L1 threshold, which here grows with the coordinate's own gradients, so
that a weight must be significant to differ from zero; the model is a short list that every task can hold. Weights
are never negative: evidence adds up, and a long document does not dilute it. The fit takes a bounded sample of
labelled documents, in shards: each pass trains the shards in parallel from the same state and adds up what they
learned, in a staged table. Scoring covers all documents and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.hashing import mix, sequences
from foliant.llm.staging import stage
from foliant.llm.tokens import slices

BITS = 19  # features are hashed to so many bits
#: Labelled documents for the fit, at most: those with the smallest digest of their id. All, if there are fewer.
SAMPLE = 12_000
STEM = 6
DENSITIES = (0.01, 0.02)
SHARDS = 4
PASSES = 4
LISTS = 512  # rows in which the state travels
ALPHA, BETA, L1 = 1.0, 1.0, 2.5
THRESHOLD = 0.7

_BLANK = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_PAIR, _SKIP, _STEM = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), 0x8EBC6AF09C88C6E3


def features(text: bytes) -> np.ndarray:
    """Distinct hashed features of a whole text.

    Words, pairs of neighbours, pairs with one word between, and stems (the first bytes of a word): one feature for
    a stem that occurs, one more for each of the ``DENSITIES`` that its share of the words reaches.
    """
    words = text.translate(_BLANK).lower().split()
    if not words:
        return np.zeros(0, np.int64)
    w = np.concatenate(list(sequences(words, 1)))
    stems, n = np.unique(np.concatenate(list(sequences([x[:STEM] for x in words], 1))), return_counts=True)
    grams = [w, w[:-1] * _PAIR + w[1:], w[:-2] * _SKIP + w[2:]]
    grams += [stems[n >= share * len(words)] + np.uint64(_STEM * k % 2**64) for k, share in enumerate((0, *DENSITIES), 1)]
    return np.unique(np.concatenate([mix(g) >> np.uint64(64 - BITS) for g in grams])).astype(np.int64)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The proximal step in closed form: zero unless z is below the threshold of its coordinate."""
    root = np.sqrt(n)
    return np.maximum(0.0, -(z + L1 * root)) / ((BETA + root) / ALPHA)


def _chance(total: float) -> float:
    return 1 / (1 + np.exp(-max(-35.0, min(35.0, total))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample as features: a list of numbers in place of each text."""
    for batch in batches:
        for b in slices(batch, "text"):
            found = pa.array([features(t).astype(np.int32) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.record_batch([b.column("shard"), b.column("place"), b.column("doc_id"), b.column("label"), found], names=["shard", "place", "doc_id", "label", "found"])


def _learn(bias: float):
    """One pass. Rows come by shard: first the state (lists of at, z, n), then the documents, one at a time."""

    def pass_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, z, n, z0, n0 = None, *[np.zeros(0)] * 4

        def learned() -> pa.RecordBatch:
            hit = np.flatnonzero(n != n0)
            return pa.record_batch([pa.array(hit.astype(np.int32)), pa.array(z[hit] - z0[hit]), pa.array(n[hit] - n0[hit])], names=["at", "z", "n"])

        for b in batches:
            shard, is_doc = b.column("shard").to_numpy(), b.column("coordinates").is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(is_doc) != 0)) + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if shard[lo] != now:
                    if now is not None:
                        yield learned()
                    now, (z, n, z0, n0) = shard[lo], np.zeros((4, 1 << BITS))
                part = b.slice(lo, hi - lo)
                if not is_doc[lo]:
                    at, z_at, n_at = (x.to_numpy() for x in part.column("coordinates").flatten().flatten())
                    z[at] = z0[at] = z_at
                    n[at] = n0[at] = n_at
                    continue
                for found, label in zip(part.column("found"), part.column("label").to_pylist()):
                    at = found.values.to_numpy()
                    w = weights(z[at], n[at])
                    g = _chance(w.sum() + bias) - label
                    sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                    z[at] += g - sigma * w
                    n[at] += g * g
        if now is not None:
            yield learned()

    return pass_


Model = tuple[np.ndarray, np.ndarray, float]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Numbers of the features that have a weight, the weights, and the bias. ``labels``: doc_id and label (0 or 1).

    Null labels and null texts are skipped; of several labels of a document the largest counts. With no labelled
    row the model has no feature and calls nothing toxic. The state of all coordinates is a staged table, which the
    tasks of a pass read and add to; the driver sees the weights that are not zero.
    """
    spark = docs.sparkSession
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    chosen = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample)  # the sample, see SAMPLE
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("shard", F.pmod("place", F.lit(SHARDS)).cast("int"))
    fields = "shard int, place long, doc_id long, label double, found array<int>"
    rows = stage(rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_features, fields), "labelled")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("toxic")).first()
    if not size["n"]:
        return np.zeros(0, np.int64), np.zeros(0), -2.0
    bias = float(np.log((size["toxic"] + 1) / (size["n"] - size["toxic"] + 1))) - 1
    state = spark.createDataFrame([], "at int, z double, n double")
    for _ in range(PASSES):
        lists = state.groupBy(F.pmod("at", F.lit(LISTS))).agg(F.collect_list(F.struct("at", "z", "n")).alias("coordinates"))  # 2**BITS / LISTS each at most
        to_all = lists.select("coordinates", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"))
        dealt = rows.unionByName(to_all, allowMissingColumns=True).repartition(SHARDS, "shard")
        dealt = dealt.sortWithinPartitions("shard", F.col("coordinates").isNull(), "place", "doc_id")
        learned = dealt.mapInArrow(_learn(bias), "at int, z double, n double")
        state = stage(state.unionByName(learned).groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n")), "state", rows=1 << BITS)
    root = F.sqrt("n")
    weight = (-F.col("z") - L1 * root) / ((BETA + root) / ALPHA)  # see ``weights``
    found = state.select("at", weight.alias("w")).where("w > 0").orderBy("at").collect()  # the model: 2**BITS rows at most, some hundreds
    return np.array([r["at"] for r in found], np.int64), np.array([r["w"] for r in found]), bias


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` and the score (0 to 1, called ``name``) of all rows. Null and empty texts have no feature, so a low score."""
    at, w, bias = model

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for b in batches:
            scores = [_chance(dense[features(t or b"")].sum() + bias) for t in b.column("scored text").to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, name])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("binary").alias("scored text")).mapInArrow(rows, f"{fields}, `{name}` double")


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxic_scores(docs: DataFrame, labels: DataFrame, keep: list[str], sample: int = SAMPLE, name: str = "score") -> DataFrame:
    """Scores of all rows by a model that never saw a held-out row's label."""
    train = labels.where(~held_out("doc_id")).select("doc_id", F.col("toxic").alias("label"))
    return score(docs, fit(docs, train, sample), keep, name)
