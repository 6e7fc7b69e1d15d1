"""Token ids as Parquet list columns that can be read by row and by column.

A file holds a range of doc_ids in ascending order: the id, its place, the number of tokens and the tokens as a list
of integers with dictionary encoding (16 bits an id before compression); the counters get delta encoding. Row
groups and pages are small and Parquet's page index is written, so a reader that wants counts reads no tokens, and
one that wants a few documents reads a few pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.tokens import encoder, slices, vocabulary

END = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
FIELDS = "doc_id long, part int, place long, n_tokens long, tokens array<int>"


def _encode(path: str, end: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place = encoder(path).encode, TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = encode(batch.column("text"))
                n = batch.num_rows
                own = np.insert(ids.astype(np.int32), at[1:], end)
                offsets = (at + np.arange(n + 1)).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(own))
                columns = [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(place + np.arange(n)), pa.array(np.diff(offsets).astype(np.int64)), tokens]
                place += n
                yield pa.record_batch(columns, names=["doc_id", "part", "place", "n_tokens", "tokens"])

    return rows


def write_token_files(docs: DataFrame, folder: str, end: int = END, path: str | None = None) -> None:
    """Encode whole texts and write them to ``folder`` in ascending doc_id order, one range of ids to a file.

    Null and empty texts are the end id alone. Rows without a doc_id come first; rows that repeat one stay together,
    ordered by text. Other columns are not written; an empty table gives files without rows.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#place": "false",
        "parquet.dictionary.page.size": 1 << 20, "parquet.writer.version": "PARQUET_2_0",
    }
    ordered.mapInArrow(_encode(path or vocabulary(), end), FIELDS).write.options(**options).parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FIELDS).parquet(folder)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = b.column("tokens")
        at, ids = tokens.offsets.to_numpy(), tokens.values.to_numpy().astype("<u4")
        sums = [zlib.crc32(ids[lo:hi].tobytes()) for lo, hi in zip(at[:-1], at[1:])]
        yield pa.record_batch([*(b.column(n) for n in ("doc_id", "part", "place")), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    found = read_token_files(spark, folder).select("doc_id", "part", "place", "tokens")
    found = found.mapInArrow(_checksums, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    sizes = read_token_files(spark, folder).groupBy("part").agg(F.sum("n_tokens").alias("size"))  # reads two columns
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))  # a row per file
    within = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("place"))), F.lit(0))
    return found.withColumn("within", within).join(bases, "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
