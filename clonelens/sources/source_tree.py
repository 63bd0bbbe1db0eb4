"""``spark.read.format("source_tree")``: every source file under a folder.

Spark's own file sources silently leave out names starting with ``_`` or ``.``
(``__init__.py``), which this source keeps.  The driver only looks for enough
folders to give every task one (``_MIN_FOLDERS``); tasks list and read what is
below their folder, file by file.  The tree has to be mounted on all executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from clonelens.functions.ranking import dense_index
from clonelens.session import staged

_SCHEMA = "path string, repo string, content string"
_MIN_FOLDERS = 512  # the driver goes down the tree until it has so many folders
_BATCH_BYTES = 8 << 20


def decode_source(data: bytes) -> str:
    """Text as a lenient reader sees it: undecodable bytes dropped, one kind of newline."""
    return data.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")


@dataclass
class Chunk(InputPartition):
    """A folder; ``deep`` tells whether the folders below belong to it as well."""

    folder: str
    deep: bool

    def __init__(self, folder: str, deep: bool) -> None:
        self.folder, self.deep = folder, deep


class SourceTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"].removeprefix("file://").rstrip("/")
        self.suffix = options.get("suffix", ".py")
        self.level = options.get("repo_level", "leaf")

    def _repository(self, folder: str) -> str:
        """The leaf folder's name, or with level 'root' the first folder below the root."""
        if self.level == "leaf":
            return os.path.basename(folder)
        inside = os.path.relpath(folder, self.root)
        return os.path.basename(self.root) if inside == "." else inside.split(os.sep)[0]

    def partitions(self) -> list[Chunk]:
        done, level = [], [self.root]
        while level and len(done) + len(level) < _MIN_FOLDERS:
            done += [Chunk(folder, False) for folder in level]
            level = [below for folder in level for below in _subfolders(folder)]
        return done + [Chunk(folder, True) for folder in level]

    def _files(self, chunk: Chunk) -> Iterator[tuple[str, str]]:
        """(path, repository) of the chunk's source files."""
        for folder, below, names in os.walk(chunk.folder):
            below.sort()
            if not chunk.deep:
                below.clear()
            for name in sorted(names):
                if name.endswith(self.suffix):
                    yield os.path.join(folder, name), self._repository(folder)

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, str]] = []
        size = 0
        for path, repo in self._files(partition):
            try:
                with open(path, "rb") as file:
                    text = decode_source(file.read())
            except OSError:  # an unreadable file is skipped
                continue
            rows.append((path, repo, text))
            size += len(text)
            if size >= _BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _subfolders(folder: str) -> list[str]:
    """Folders directly below; links are not followed, as when a task walks the tree."""
    try:
        with os.scandir(folder) as entries:
            return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
    except OSError:
        return []


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.string()) for c in zip(*rows)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "repo", "content"])


class SourceTree(DataSource):
    """Options: ``path``, ``suffix`` ('.py'), ``repo_level`` ('leaf' or 'root')."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(dict(self.options))


def read_source_tree(spark: SparkSession, path: str, repo_level: str = "leaf") -> DataFrame:
    """(path, repo, content) of all ``*.py`` files below ``path``."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("repo_level", repo_level).load(path)


def number_files(files: DataFrame) -> DataFrame:
    """Add ``file_id``: 0, 1, 2, ... in path order.

    The tree is read once; only paths are ranked, contents join their number.
    """
    files = staged(files, "source-files")
    numbers = dense_index(files.select("path").distinct(), ["path"], name="file_id")
    return files.join(numbers, "path").select(*files.columns, "file_id")
