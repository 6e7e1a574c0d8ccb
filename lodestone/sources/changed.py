"""Files of a tree that are new or changed, as a batch or a stream: a data source for ``spark.read`` and ``spark.readStream``.

The stream's offset is the pair (time of change, path) of the last file given. A micro-batch takes the files after it, in that
order, so a changed file comes again and others don't, also after a restart. Files that changed within the last ``settle`` seconds
wait for a later batch, since another file may still come to have their time. The tree is listed on the driver; it is
read in tasks, ``group`` files each.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, mtime double, size long, content binary"


def listed(path: str, suffixes: tuple[str, ...] = ()) -> list[tuple[float, str, int]]:
    """(mtime, path, size) of the files under a path of any file system that Arrow knows, by time and path."""
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    found = system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns / 1e9, f.path, f.size) for f in found if f.type == fs.FileType.File and (not suffixes or f.path.endswith(suffixes)))


@dataclass
class Files(InputPartition):
    files: list


class _Reader:
    def __init__(self, options):
        self.path = options["path"]
        self.group, self.settle = int(options.get("group", "200")), float(options.get("settle", "2"))
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)

    def parts(self, files: list) -> list[Files]:
        return [Files(files[i : i + self.group]) for i in range(0, len(files), self.group)]

    def read(self, partition: Files):
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for mtime, path, size in partition.files:
            try:
                with system.open_input_stream(path) as f:
                    yield path, mtime, size, bytes(f.read())
            except FileNotFoundError:  # gone since it was listed
                continue


class _Batch(_Reader, DataSourceReader):
    def partitions(self):
        return self.parts(listed(self.path, self.suffixes))


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"mtime": 0.0, "path": ""}

    def latestOffset(self) -> dict:
        till = time.time() - self.settle
        settled = [f for f in listed(self.path, self.suffixes) if f[0] <= till]
        return {"mtime": settled[-1][0], "path": settled[-1][1]} if settled else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        first, last = (start["mtime"], start["path"]), (end["mtime"], end["path"])
        return self.parts([f for f in listed(self.path, self.suffixes) if first < f[:2] <= last])

    def commit(self, end: dict) -> None:
        pass


class ChangedFiles(DataSource):
    """Options: path; suffixes (with commas), group, settle (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> str:
    """Makes the source known to the session; returns the name of its format."""
    spark.dataSource.register(ChangedFiles)
    return ChangedFiles.name()
