"""A data source of the files of a folder, walked level by level on the executors."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders from which the walk is dealt to tasks.
SPREAD = 256


class _Branch(InputPartition):
    def __init__(self, folders: list[tuple[str, int]], files: list[str]):
        super().__init__(None)
        self.folders, self.files = folders, files


def _entries(folder: str) -> tuple[list[str], list[str]]:
    """(folders, files) in a folder but those whose names begin with a dot; links to folders are not followed."""
    folders, files = [], []
    with os.scandir(folder) as found:
        for e in found:
            if not e.name.startswith("."):
                (folders if e.is_dir(follow_symlinks=False) else files).append(e.path)
    return folders, files


class FolderReader(DataSourceReader):
    def __init__(self, root: str, depth: int | None):
        self.root, self.depth = root, depth

    def partitions(self) -> list[InputPartition]:
        """Walk down until there are enough folders to deal out; a folder below the depth is never opened."""
        level, files, at = [self.root], [], 0
        while level and len(level) < SPREAD and (self.depth is None or at <= self.depth):
            below = []
            for folder in level:
                inner, own = _entries(folder)
                below += inner
                files += own
            level, at = below, at + 1
        left = level if self.depth is None or at <= self.depth else []
        return [_Branch([(f, at) for f in left[k::SPREAD]], files if k == 0 else []) for k in range(min(SPREAD, max(1, len(left))))]

    def read(self, partition: _Branch) -> Iterator[tuple[str]]:
        for path in partition.files:
            yield (path,)
        todo = list(partition.folders)
        while todo:
            folder, at = todo.pop()
            inner, own = _entries(folder)
            for path in own:
                yield (path,)
            if self.depth is None or at < self.depth:
                todo += [(f, at + 1) for f in inner]


class FolderSource(DataSource):
    """``spark.read.format("waymark_folder").option("depth", 4).load(root)``: (path) of all files at most ``depth`` folders down."""

    @classmethod
    def name(cls) -> str:
        return "waymark_folder"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> FolderReader:
        depth = self.options.get("depth")
        return FolderReader(self.options["path"], None if depth is None else int(depth))
