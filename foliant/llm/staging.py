"""Tables written between the phases of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where a session has none (tests), it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-"))
        set_before = spark.sparkContext.getCheckpointDir()
    return set_before


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, **options: object) -> DataFrame:
    """Write a table and read it back: what reads it does not depend on executors that are gone."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task writes at least, if its table is staged with a number of rows.
ROWS_A_FILE = 20_000


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``rows``: about how many there are. Small tables are then not dealt to many files; each core still gets two tasks.

    On a local file system without Hadoop's native library a task starts two processes for each file that it creates.
    """
    if rows is not None:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))
    return write(df, new_path(df.sparkSession, name), compression="zstd")


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
