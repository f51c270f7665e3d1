"""``spark.read.format("foliant_documents")``: block rows of the files under a path."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliant.sources.files import open_input
from foliant.sources.packages import SCHEMA, parse


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class DocumentReader(DataSourceReader):
    """One partition for each ``filesPerPartition`` files (16 by default)."""

    def __init__(self, options):
        self.path, self.per = options["path"], int(options.get("filesPerPartition", 16))
        self.suffixes = tuple(f".{s.strip()}" for s in options.get("suffixes", "").split(",") if s.strip())

    def partitions(self) -> list[Files]:
        if "://" in self.path and not self.path.startswith("file:"):
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(self.path)
            scheme = self.path.split("://")[0]
            found = [f"{scheme}://{i.path}" for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
        else:
            root = "/" + self.path[5:].lstrip("/") if self.path.startswith("file:") else self.path
            found = [os.path.join(d, n) for d, _, names in os.walk(root) for n in names]
        found = sorted(f for f in found if not self.suffixes or f.lower().endswith(self.suffixes))
        return [Files(found[i : i + self.per]) for i in range(0, len(found), self.per)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open_input(path) as f:
                data = f.read()
            yield from parse(data, path)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "foliant_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)
