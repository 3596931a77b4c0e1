"""Source trees as files(project_id, path, content)."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, LessThan, LessThanOrEqual

from ..functions.patterns import CONFIG_NAMES, EXTENSIONS, MOST_BYTES, SKIPPED_FOLDERS


class FileBatch(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


class TreeReader(DataSourceReader):
    """Lists a tree without entering skipped and hidden folders, then reads the files that are left, some in a task."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.project = options.get("project_id", "")
        self.most_bytes = int(options.get("most_bytes", MOST_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", 32 << 20))
        self.every_kind = options.get("every_kind", "false").lower() == "true"

    def wanted(self, name: str, size: int) -> bool:
        dot = name.rfind(".")
        known = self.every_kind or name in CONFIG_NAMES or (dot > 0 and name[dot:].lower() in EXTENSIONS)
        return known and not name.startswith(".") and size <= self.most_bytes

    def opened(self) -> tuple:
        """The file system and the root's path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if ":/" in self.root else f"file://{self.root}")

    def listed(self) -> Iterator[tuple[str, str, int]]:
        """(place, path below the root, size) of the files worth reading, folder by folder.

        In a local file system links to folders are not followed, and links to files only within the root.
        """
        from pyarrow import fs

        system, base = self.opened()
        base = base.rstrip("/")
        local, within = isinstance(system, fs.LocalFileSystem), os.path.realpath(base) + "/"
        folders = [base]
        while folders:
            for info in sorted(system.get_file_info(fs.FileSelector(folders.pop())), key=lambda i: i.path):
                if local and os.path.islink(info.path) and (info.type == fs.FileType.Directory or not os.path.realpath(info.path).startswith(within)):
                    continue
                if info.type == fs.FileType.Directory:
                    if info.base_name not in SKIPPED_FOLDERS and not info.base_name.startswith("."):
                        folders.append(info.path)
                elif info.type == fs.FileType.File and self.wanted(info.base_name, info.size):
                    yield info.path, info.path[len(base) + 1 :], info.size

    def partitions(self) -> list[FileBatch]:
        batches: list[list[tuple[str, str, int]]] = []
        room = 0
        for file in self.listed():
            if not batches or room < file[2]:
                batches.append([])
                room = self.batch_bytes
            batches[-1].append(file)
            room -= file[2]
        return [FileBatch(b) for b in batches or [[]]]

    def read(self, partition: FileBatch) -> Iterator[tuple]:
        system, _ = self.opened()
        for place, path, size in partition.files:
            with system.open_input_stream(place) as stream:
                yield self.project, path, size, stream.read()


class PushedTreeReader(TreeReader):
    """A reader for sessions that push filters down to Python data sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds on the size narrow the listing; all other filters stay with Spark."""
        for f in filters:
            if isinstance(f, LessThanOrEqual | LessThan) and f.attribute == ("size",):
                self.most_bytes = min(self.most_bytes, int(f.value) - isinstance(f, LessThan))
            else:
                yield f


class TreeSource(DataSource):
    """spark.read.format("source_tree"): options project_id, most_bytes, batch_bytes (of a task), every_kind (files of any name)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "project_id string, path string, size long, content binary"

    def reader(self, schema) -> TreeReader:
        options = dict(self.options)
        return (PushedTreeReader if options.get("pushdown") == "true" else TreeReader)(options)


def read_tree(spark, root: str, project_id: str, **options: str) -> DataFrame:
    """The files below root that an index admits, with their paths relative to it; bytes that are no UTF-8 are replaced.

    What lies below skipped or hidden folders is neither listed nor opened.
    """
    spark.dataSource.register(TreeSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    files = spark.read.format("source_tree").options(project_id=project_id, pushdown=pushdown, **options).load(root)
    return files.select("project_id", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
