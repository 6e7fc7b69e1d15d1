"""A page's output as files: one folder per page with its Markdown, manifest and diagram sources, and a listing of what lies there."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

MARKDOWN, MANIFEST, SOURCES = "output.md", "screenshot_manifest.json", "mermaid_sources"
SCHEMA = "folder string, md string, manifest string, sources array<struct<name: string, source: string>>"


@dataclass
class Written(WriterCommitMessage):
    pages: int
    files: int


class _Writer(DataSourceWriter):
    """Every file has one name, whichever task writes it, and appears whole: it is written aside and moved. So a task that failed
    half way, or one that runs twice, leaves each file once."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = fs.FileSystem.from_uri(self.path)
        aside = f"{root}/_aside/{uuid.uuid4().hex}"
        files.create_dir(aside, recursive=True)
        n_pages = n_files = 0
        for row in iterator:
            page = {MARKDOWN: row["md"], MANIFEST: json.dumps(json.loads(row["manifest"]), indent=2, ensure_ascii=False)}
            page |= {f"{SOURCES}/{s['name']}": s["source"] for s in row["sources"]}
            for name, text in page.items():
                target = f"{root}/{row['folder']}/{name}"
                files.create_dir(target.rpartition("/")[0], recursive=True)
                with files.open_output_stream(f"{aside}/file") as out:
                    out.write(text.encode())
                files.move(f"{aside}/file", target)
            n_pages, n_files = n_pages + 1, n_files + len(page)
        files.delete_dir(aside)
        return Written(n_pages, n_files)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        self._clear(files, root)
        done = [m for m in messages if m]
        with files.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"pages": sum(m.pages for m in done), "files": sum(m.files for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    @staticmethod
    def _clear(files: fs.FileSystem, root: str) -> None:
        """What tasks that ended half way have left aside."""
        if files.get_file_info(f"{root}/_aside").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_aside")


class PageFolders(DataSource):
    """Sink ``page_folders``: rows of ``SCHEMA`` to files below the URI in the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "page_folders"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def folder_name(page_id: Column) -> Column:
    """The page's identity as a name for a folder. Where signs had to be replaced a hash keeps names apart."""
    text = page_id.cast("string")
    plain = F.regexp_replace(text, r"[^A-Za-z0-9.-]+", "_")
    return F.when(plain == text, text).otherwise(F.concat(plain, F.lit("_"), F.hex(F.xxhash64(text))))


def write_folders(table: DataFrame, uri: str) -> None:
    """Write a table with page_id, md, manifest and blocks (see ``Conversion.table``) as one folder per page below ``uri``, a shared folder."""
    table.sparkSession.dataSource.register(PageFolders)
    sources = F.expr("""transform(filter(blocks, b -> b.diagram_index IS NOT NULL),
        b -> named_struct('name', format_string('mermaid_%02d.mmd', b.diagram_index), 'source', b.body))""")
    rows = table.select(folder_name(F.col("page_id")).alias("folder"), "md", "manifest", sources.alias("sources"))
    rows.write.format("page_folders").mode("append").option("path", uri).save()


def list_files(spark: SparkSession, uri: str) -> DataFrame:
    """The files that lie below a folder of page folders: folder and path, relative to the page's. No content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri).select("path")
    below = found.select(F.element_at(F.split("path", f"/{re.escape(uri.rstrip('/').rpartition('/')[2])}/"), -1).alias("below"))
    folder = F.substring_index("below", "/", 1)
    return below.select(folder.alias("folder"), F.substring(F.col("below"), F.length(folder) + 2, F.length("below")).alias("path"))
