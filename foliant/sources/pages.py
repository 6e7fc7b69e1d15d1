"""Page sources. A corpus has the columns page_id (unique), url and html."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages kept as a Parquet table. A missing path raises, and only the columns used are scanned.

    A table that reads in fewer splits than there are cores is dealt out first: pages grow a lot when parsed. A larger one is
    read as it lies, without an exchange.
    """
    pages = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return pages if pages.rdd.getNumPartitions() >= cores else pages.repartition(cores)


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """One page per HTML file below ``path``; the file's URI is its identity."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    uri = F.col("_metadata.file_path")
    return files.select(uri.alias("page_id"), uri.alias("url"), F.col("value").alias("html"))
