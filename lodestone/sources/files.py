"""Trees of files as DataFrames: which files a scan takes, and their texts.

Tasks list targets and read files, through Python's and Arrow's file systems, so any store that Arrow knows (local disks,
HDFS, S3, GCS) will do and nothing is gathered on the driver. Spark's own file readers leave out names that start with an
underscore, as ``__init__.py``, so they do not serve here.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.languages import PRUNED, PRUNED_IN_CLONES, READ, doc_type, language

_TARGET = "place int, path string, type string, recursive boolean, repo string"
_FOUND = "place int, repo string, rel_path string, mtime double, source string"


def _filesystem(path: str) -> tuple[pafs.FileSystem | None, str]:
    """The file system of a path, None for the local one, and the path in it."""
    scheme = re.match(r"([a-z0-9]+):", path, re.I)
    if scheme is None:
        return None, os.path.abspath(path)
    if scheme[1].lower() == "file":
        return None, re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def _walk(path: str, recursive: bool, pruned: tuple[str, ...]) -> Iterator[tuple[str, float]]:
    """(path, time) of the files below a folder that a scan takes; links to folders are not followed."""
    taken = lambda name: not name.startswith(".") and name.endswith(tuple(READ))
    entered = lambda name: recursive and not name.startswith(".") and name not in pruned
    fs, top = _filesystem(path)
    if fs is None:
        for folder, folders, names in os.walk(top):
            folders[:] = [d for d in folders if entered(d)]
            for n in filter(taken, names):
                own = os.path.join(folder, n)
                yield own, os.path.getmtime(own)
        return
    todo = [top]
    while todo:
        for info in fs.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)):
            if info.type == pafs.FileType.Directory and entered(info.base_name):
                todo.append(info.path)
            elif info.type == pafs.FileType.File and taken(info.base_name):
                yield info.path, info.mtime_ns / 1e9


def _one(path: str) -> Iterator[tuple[str, float]]:
    fs, own = _filesystem(path)
    if own.endswith(tuple(READ)):
        if fs is None and os.path.isfile(own):
            yield own, os.path.getmtime(own)
        elif fs is not None and (info := fs.get_file_info(own)).type == pafs.FileType.File:
            yield own, info.mtime_ns / 1e9


def scan(spark: SparkSession, targets: list[dict], clone: bool = False) -> DataFrame:
    """(filepath, rel_path, repo, mtime, language, doc_type, source) of the files of enabled targets.

    A target: path, type (``directory`` or ``file``), recursive, enabled, repo. Hidden files and folders are left out, and
    folders of dependencies; missing targets have no files. A file of several targets belongs to the last. In a clone the
    path is ``repo://rel_path`` and the time 0. A task lists a target; texts are read by ``texts``.
    """
    rows = [(i, t["path"], t.get("type", "directory"), t.get("recursive", True), t.get("repo", "local")) for i, t in enumerate(targets) if t.get("enabled", True)]
    pruned = PRUNED_IN_CLONES if clone else PRUNED

    def listed(batches):
        for batch in batches:
            out = []
            for place, path, kind, recursive, repo in batch.itertuples(index=False):
                scheme = "" if _filesystem(path)[0] is None else path.split("://")[0] + "://"
                top = _filesystem(path)[1]
                base = os.path.dirname(top) if kind == "file" else top
                for own, time in _one(path) if kind == "file" else _walk(path, recursive, pruned):
                    out.append((place, repo, os.path.relpath(own, base), time, scheme + own))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["place", "repo", "rel_path", "mtime", "source"])
                        out = []
            yield pd.DataFrame(out, columns=["place", "repo", "rel_path", "mtime", "source"]).astype({"place": "int32", "mtime": "float64"})

    found = spark.createDataFrame(rows, _TARGET).repartition(max(1, len(rows))).mapInPandas(listed, _FOUND)
    if clone:
        found = found.withColumns({"filepath": F.concat("repo", F.lit("://"), "rel_path"), "mtime": F.lit(0.0)})
    else:
        found = found.withColumn("filepath", F.col("source"))
    last = found.groupBy("filepath").agg(F.max_by(F.struct("rel_path", "repo", "mtime", "source"), "place").alias("r")).select("filepath", "r.*")
    kind = language(F.col("filepath"))
    return last.withColumns({"language": kind, "doc_type": doc_type(kind)})


def _bytes(path: str) -> bytes | None:
    fs, own = _filesystem(path)
    try:
        if fs is None:
            with open(own, "rb") as f:
                return f.read()
        with fs.open_input_stream(own) as f:
            return f.read()
    except FileNotFoundError:
        return None


def texts(files: DataFrame, path: str = "source") -> DataFrame:
    """``files`` with content, UTF-8 without the bytes that are invalid. Tasks read the files; one that is gone by then is left out."""
    parts = max(8, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = StructType([*files.schema.fields, StructField("content", StringType())])

    def read(batches):
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.iloc[i : i + 64].copy()
                part["content"] = [None if (raw := _bytes(p)) is None else raw.decode("utf-8", errors="ignore") for p in part[path]]
                yield part[part["content"].notna()]

    # the rows are short, but each stands for a file, so their number of partitions is given
    return files.repartition(parts, path).mapInPandas(read, schema)


def remote_heads(rows: list[tuple[int, str | None]], spark: SparkSession) -> DataFrame:
    """(id, sha) of remote heads that a caller has read."""
    return spark.createDataFrame(rows, "id long, sha string")


def head_of(ls_remote: str) -> str | None:
    """The commit in the first line of ``git ls-remote`` output; None without one."""
    lines = [x for x in ls_remote.splitlines() if x.strip()]
    return lines[0].split()[0] if lines else None
