"""The registered queries of the numbered operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import capfilter, decontamination, licences, minhash, packing, pii, prefixtrie, repeats, resampling, sharding, substrings, tokenfiles, toxicity
from foliant.llm.oracles import ORACLES  # noqa: F401 - the entry reads both
from foliant.llm.staging import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def cap_filter_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_vectors(table(spark, sf_dir, "embeddings"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(table(spark, sf_dir, "documents"))


def ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"))


def licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), folder)
    return tokenfiles.token_index(spark, folder)


def histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    done = sharding.shard_by_bytes(docs.withColumn("text_crc32", digest), keep=["doc_id", "text_crc32"])
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def prefix_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def anchor_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def sparse_table_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations")).drop("key", "parent_key")


QUERIES = {
    "op1_minhash_near_duplicates": minhash_near_duplicates,
    "op2_cap_filter_vectors": cap_filter_vectors,
    "op3_best_fit_packing": best_fit_packing,
    "op4_boosted_pii": boosted_pii,
    "op5_ftrl_toxicity": ftrl_toxicity,
    "op6_licence_digests": licence_digests,
    "op7_token_files": token_files,
    "op8_histogram_sharding": histogram_sharding,
    "op9_suffix_repeats": suffix_repeats,
    "op10_qgram_decontamination": qgram_decontamination,
    "op11_prefix_crc_resampling": prefix_crc_resampling,
    "op12_anchor_substrings": anchor_substrings,
    "op13_sparse_table_trie": sparse_table_trie,
}
