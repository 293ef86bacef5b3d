"""Local files as local state and chunks.

``listing_source`` is a Python data source that lists folders with
``os.scandir``, in subtrees of the first levels that have many, and so also sees
empty and hidden files, which Spark's binary file reader leaves out. It is for
folders that every executor sees (a mounted drive).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.functions.scalars import relative_path
from tidemark.model import INVENTORY


#: Folders that are looked into on the driver until so many are left to be listed by tasks.
SUBTREES = 2048


class _Subtree(InputPartition):
    def __init__(self, tops: list[str], deep: bool):
        super().__init__(",".join(tops[:1]))
        self.tops, self.deep = tops, deep


class _ListingReader(DataSourceReader):
    def __init__(self, root: str, label: str, subtrees: int = SUBTREES):
        self.root, self.label, self.subtrees = root.rstrip("/") or "/", label, subtrees

    def _folders(self, at: str) -> list[str]:
        with os.scandir(os.path.join(self.root, at)) as entries:
            return [f"{at}/{e.name}" if at else e.name for e in entries if e.is_dir(follow_symlinks=False)]

    def partitions(self) -> list[InputPartition]:
        """The subtrees of about ``subtrees`` folders, found level by level, and the folders above them without what is below."""
        above, todo = [], [""]
        while todo and len(todo) + len(above) < self.subtrees:
            above += todo
            todo = sorted(f for at in todo for f in self._folders(at))
        shallow = [_Subtree(above[i : i + 16], False) for i in range(0, len(above), 16)]
        return shallow + [_Subtree([f], True) for f in todo]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        todo = list(partition.tops)
        while todo:
            at = todo.pop()
            with os.scandir(os.path.join(self.root, at)) as entries:
                for e in entries:
                    path = f"{at}/{e.name}" if at else e.name
                    folder = e.is_dir(follow_symlinks=False)
                    if not folder and not e.is_file(follow_symlinks=False):
                        continue
                    if folder and partition.deep:
                        todo.append(path)
                    size = None if folder else e.stat(follow_symlinks=False).st_size
                    yield self.label, path, at, e.name, "folder" if folder else "file", size, path.count("/") + 1


class ListingSource(DataSource):
    """``spark.read.format("tidemark_listing").option("root", "owned").load(folder)``: inventory rows."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_listing"

    def schema(self) -> StructType:
        return INVENTORY

    def reader(self, schema: StructType) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("a folder to list is needed")
        return _ListingReader(self.options["path"], self.options.get("root", "owned"))


def listing(spark: SparkSession, folder: str, root: str = "owned") -> DataFrame:
    spark.dataSource.register(ListingSource)
    return spark.read.format("tidemark_listing").option("root", root).load(folder)


def local_state(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``size`` and ``content`` of the files below a folder of any file system; Spark leaves out empty and hidden ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    plain = F.regexp_replace("path", "^file:/+", "/")
    top = folder.removeprefix("file:") if folder.startswith("file:") else folder
    return files.select(relative_path(plain, "/" + top.strip("/")).alias("path"), F.col("length").alias("size"), "content")
