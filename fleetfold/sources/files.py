"""Small files of many applications as rows, hidden names included: a source and a sink.

Spark's own file sources hide names that begin with ``_`` or ``.``; configuration
folders may hold such files. The source lists and reads ``<path>/<app>/<file>``: the
driver lists application folders only, and each task lists and reads its own.
Paths are anything that Arrow's file systems open (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from fleetfold import schema as S

#: Rows of the source; ``reason`` tells why a file was rejected: its content is null then.
ROWS = "app_id string, file_name string, n_bytes bigint, content string, reason string"
BY_NAME, BY_SIZE, BY_CODING = "name", "size", "encoding"
_FOLDERS = 64
_BATCH_BYTES = 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Folders(InputPartition):
    paths: list[str]


class ConfFileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.budget = int(options.get("budget", S.BUNDLE_BUDGET))
        self.skipped = options.get("skipped", "")

    def partitions(self) -> list[Folders]:
        store, root = opened(self.path)
        apps = sorted(i.path for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory)
        return [Folders(apps[i:i + _FOLDERS]) for i in range(0, len(apps), _FOLDERS)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        rows, held = [], 0
        for folder in partition.paths:
            app = folder.rstrip("/").rsplit("/", 1)[-1]
            for info in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda i: i.base_name):
                if info.type != fs.FileType.File:
                    continue
                content, reason = self._content(store, info)
                rows.append((app, info.base_name, info.size, content, reason))
                held += len(content or "")
                if held > _BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _content(self, store: fs.FileSystem, info: fs.FileInfo) -> tuple[str | None, str | None]:
        """Text of a file, or why it is left out; a file is only opened when name and size allow it."""
        if self.skipped and re.fullmatch(self.skipped, info.base_name):
            return None, BY_NAME
        if info.size + len(info.base_name) > self.budget:
            return None, BY_SIZE
        with store.open_input_stream(info.path) as file:
            data = file.read()
        try:
            return data.decode("utf-8"), None
        except UnicodeDecodeError:
            return None, BY_CODING


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = ["app_id", "file_name", "n_bytes", "content", "reason"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


class ConfFileWriter(DataSourceWriter):
    """One file per row (app_id, file_name, content), written under its own name.

    A repeated task writes the same files again, so a lost executor leaves nothing behind.
    """

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = opened(self.path)
        made: set[str] = set()
        for app, name, content in ((r["app_id"], r["file_name"], r["content"]) for r in rows):
            if app not in made:
                store.create_dir(f"{root}/{app}", recursive=True)
                made.add(app)
            with store.open_output_stream(f"{root}/{app}/{name}") as file:
                file.write(content.encode("utf-8"))
        return WriterCommitMessage()


class ConfFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "conf_files"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return ConfFileReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ConfFileWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ConfFiles)
