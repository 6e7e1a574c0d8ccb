"""Keyed tables as Parquet under a log of versions: upsert, insert, delete, replace, swap, update.

A table is a folder with two others. ``data`` holds the rows, a folder a change, partitioned inside; ``_log`` holds a
small file a version, named by its number, that lists the folders of ``data`` which make up the table. The greatest number
is the current version. A change reads it, rewrites those folders alone in which it touches a row, and publishes the next
number by a rename that fails if the number is taken; then it starts anew from the version that took it. So readers see
whole versions, a change that fails at any step leaves the table as it was, and of two writers neither loses rows. The
rename is atomic on HDFS and, within a process, on a local disk; on object stores without atomic renames one writer at a
time is safe. Folders that the last two versions lack are removed, so readers that run meanwhile finish.

Where a table is partitioned by the column, ``delete_equal`` and ``replace`` drop that partition's folders unread. Rows that
no stored key meets are appended without a rewrite; ``compact`` merges what appends leave.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: What a change makes of the rows: the folders that go, and the rows that come, or None.
Change = tuple[set[str], DataFrame | None]

#: The name of the folders of ``data``, which Spark takes for a partition; no table may have such a column.
_CHANGE = "lodestone_change"
_LOCKS: dict[str, threading.RLock] = defaultdict(threading.RLock)
_LOCKS_LOCK = threading.Lock()


class KeyExists(ValueError):
    """An insert of a key that the table has."""


class Broken(RuntimeError):
    """A table's folder has rows but no log."""


class Table:
    """A table at ``path`` with a key; ``schema`` is what readers get, whatever older files hold."""

    #: Versions that stay in the log, and those whose rows stay.
    LOGGED, KEPT = 50, 2

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: list[str], partition: list[str] | None = None, indexed: list[str] | None = None, block: int | None = None):
        """``indexed``: columns of point filters. Files are sorted by them and their row groups have Bloom filters of them, so such a
        filter skips row groups and pages. ``block``: the bytes of a row group, if other than the session's.
        """
        self.spark, self.path, self.key, self.partition = spark, path.rstrip("/"), key, partition or []
        self.indexed, self.block = indexed or [], block
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        with _LOCKS_LOCK:
            self._lock = _LOCKS[self.path]

    # files, through Hadoop's file systems, so any store that Spark reads will do

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._file(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("_log") if n.isdigit())

    def _folders(self, version: int) -> list[str]:
        fs, p = self._file(f"_log/{version:020d}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _state(self) -> tuple[int, list[str]]:
        """The current version's number and folders; (0, []) of a table that nothing was written to."""
        versions = self._versions()
        if versions:
            return versions[-1], self._folders(versions[-1])
        if self._names("data"):
            raise Broken(f"{self.path} has rows but no log")
        return 0, []

    def _publish(self, version: int, folders: list[str]) -> bool:
        """Makes ``folders`` the version; False if another writer was first."""
        fs, temporary = self._file(f"_log/.{uuid.uuid4().hex}")
        _, final = self._file(f"_log/{version:020d}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if fs.exists(final):
            fs.delete(temporary, False)
            return False
        jvm = self.spark._jvm.org.apache.hadoop.fs
        context = jvm.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, final, self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))
        except Exception as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _sweep(self, version: int) -> None:
        """Removes folders that only versions before the last ``KEPT`` have, and old entries of the log."""
        versions = [v for v in self._versions() if v <= version]
        kept = {f for v in versions[-self.KEPT :] for f in self._folders(v)}
        if len(versions) > self.KEPT:
            for folder in set(self._folders(versions[-self.KEPT - 1])) - kept:
                fs, p = self._file(f"data/{folder}")
                fs.delete(p, True)
        for v in versions[: -self.LOGGED]:
            fs, p = self._file(f"_log/{v:020d}")
            fs.delete(p, False)

    def _written(self, df: DataFrame) -> list[str]:
        """Writes rows into a new folder of ``data``; returns the folders that hold them."""
        top = f"{_CHANGE}={uuid.uuid4().hex}"
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        if self.indexed:
            rows = rows.sortWithinPartitions(*self.partition, *self.indexed)
        writer = rows.write
        for c in self.indexed:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
        if self.block:
            writer = writer.option("parquet.block.size", str(self.block))
        (writer.partitionBy(*self.partition) if self.partition else writer).parquet(f"{self.path}/data/{top}")
        found = [top]
        for _ in self.partition:
            found = [f"{f}/{n}" for f in found for n in self._names(f"data/{f}") if "=" in n]
        return found

    def _commit(self, change: Callable[[list[str]], Change]) -> None:
        with self._lock:
            while True:
                version, folders = self._state()
                if not version:
                    self._publish(1, [])
                    continue
                gone, rows = change(folders)
                new = [] if rows is None else self._written(rows)
                if not gone and not new:
                    return
                if self._publish(version + 1, [*(f for f in folders if f not in gone), *new]):
                    self._sweep(version + 1)
                    return
                for top in {f.split("/")[0] for f in new}:  # another writer was first
                    fs, p = self._file(f"data/{top}")
                    fs.delete(p, True)

    def _rows(self, folders: list[str]) -> DataFrame:
        """The rows of folders, with their file's path as ``_metadata``."""
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        inner = StructType([f for f in self.schema if f.name not in self.partition])
        for f in self.schema:
            if f.name in self.partition:
                inner = inner.add(f.name, f.dataType)
        read = self.spark.read.schema(inner.add(_CHANGE, StringType())).option("basePath", f"{self.path}/data")
        return read.parquet(*[f"{self.path}/data/{f}" for f in folders])

    def _plain(self, df: DataFrame) -> DataFrame:
        return df.select(*self.schema.fieldNames())

    def _holding(self, folders: list[str], where: Callable[[DataFrame], DataFrame]) -> set[str]:
        """The folders in which ``where`` leaves rows."""
        if not folders:
            return set()
        place = F.regexp_extract("_metadata.file_path", rf"/data/({_CHANGE}=.*)/[^/]+$", 1)
        rows = where(self._rows(folders).withColumn("_place", place)).select("_place").distinct().collect()
        return {unquote(r[0]) for r in rows}

    def read(self) -> DataFrame:
        """The current rows; columns that older files lack are null."""
        return self._plain(self._rows(self._state()[1]))

    def _completed(self, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])

    # changes

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of their key; of rows of one key that come together, one stays."""
        new = self._completed(rows).dropDuplicates(self.key)
        keys = new.select(*self.key)

        def change(folders: list[str]) -> Change:
            hit = self._holding(folders, lambda d: d.join(keys, self.key, "left_semi"))
            left = self._plain(self._rows(sorted(hit)).join(keys, self.key, "left_anti"))
            return hit, left.unionByName(new) if hit else new

        self._commit(change)

    def insert(self, rows: DataFrame, unique: list[str] | None = None, number: str | None = None) -> int | None:
        """Adds rows; raises ``KeyExists`` if one's ``unique`` columns (the key, without) are in the table already.

        ``number``: a column that takes the next whole number, of one row; it is returned.
        """
        by, given = unique or self.key, []

        def change(folders: list[str]) -> Change:
            now, new = self._plain(self._rows(folders)), rows
            if number:
                given[:] = [(now.agg(F.max(number)).first()[0] or 0) + 1]
                new = rows.withColumn(number, F.lit(given[0]))
            new = self._completed(new)
            if not new.join(now.select(*by), by, "left_semi").isEmpty():
                raise KeyExists(f"{by} is taken")
            return set(), new

        self._commit(change)
        return given[0] if given else None

    def delete(self, where: Column) -> None:
        """Rows for which ``where`` is true go; rows for which it is null stay."""

        def change(folders: list[str]) -> Change:
            hit = self._holding(folders, lambda d: d.where(where))
            return hit, self._plain(self._rows(sorted(hit))).where(~F.coalesce(where, F.lit(False))) if hit else None

        self._commit(change)

    def _of_partition(self, folders: list[str], column: str, value) -> set[str]:
        """The folders of a partition's value, by their names."""
        names = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        own = names.DEFAULT_PARTITION_NAME() if value is None or value == "" else names.escapePathName(str(value))
        return {f for f in folders if f"{column}={own}" in f.split("/")}

    def delete_equal(self, column: str, value) -> None:
        if column in self.partition:
            self._commit(lambda folders: (self._of_partition(folders, column, value), None))
        else:
            self.delete(F.col(column).eqNullSafe(F.lit(value)))

    def replace(self, column: str, value, rows: DataFrame) -> None:
        """All rows with that value go and ``rows`` come, in one change; ``rows`` may be empty."""
        new = self._completed(rows)

        def change(folders: list[str]) -> Change:
            if column in self.partition:
                return self._of_partition(folders, column, value), new
            same = F.col(column).eqNullSafe(F.lit(value))
            hit = self._holding(folders, lambda d: d.where(same))
            return hit, self._plain(self._rows(sorted(hit))).where(~same).unionByName(new) if hit else new

        self._commit(change)

    def swap(self, touched: DataFrame, rows: DataFrame | None = None) -> None:
        """Rows that agree with one of ``touched`` in its columns go and ``rows`` come, in one change; keys stay in Spark."""
        keys, by = touched.distinct(), touched.columns
        new = None if rows is None else self._completed(rows)

        def change(folders: list[str]) -> Change:
            hit = self._holding(folders, lambda d: d.join(keys, by, "left_semi"))
            left = self._plain(self._rows(sorted(hit)).join(keys, by, "left_anti")) if hit else None
            return hit, new if left is None else left if new is None else left.unionByName(new)

        self._commit(change)

    def update(self, where: Column, **values: Column) -> int:
        """Sets columns of the rows for which ``where`` is true; returns their number."""
        count = [0]

        def change(folders: list[str]) -> Change:
            hit = self._holding(folders, lambda d: d.where(where))
            now = self._plain(self._rows(sorted(hit)))
            count[0] = now.where(where).count()
            yes = F.coalesce(where, F.lit(False))
            return hit, now.withColumns({c: F.when(yes, v).otherwise(F.col(c)) for c, v in values.items()}) if hit else None

        self._commit(change)
        return count[0]

    def compact(self) -> None:
        """Rewrites the rows of all folders as one change."""
        self._commit(lambda folders: (set(folders), self._plain(self._rows(folders))) if len(folders) > 1 else (set(), None))

    def clear(self) -> None:
        self._commit(lambda folders: (set(folders), None))

    def fits(self, dimension: int | None = None, column: str = "dense") -> bool:
        """Whether stored vectors have the dimension, or there are none."""
        if dimension is None or column not in self.schema.fieldNames():
            return True
        sizes = self.read().where(F.col(column).isNotNull()).agg(F.min(F.size(column)), F.max(F.size(column))).first()
        return sizes[0] is None or (sizes[0] == dimension and sizes[1] == dimension)

    def heal(self, dimension: int, column: str = "dense") -> bool:
        """Empties the table if its vectors have another dimension; whether it did."""
        if self.fits(dimension, column):
            return False
        self.clear()
        return True
