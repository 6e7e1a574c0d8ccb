"""A lease on a shared folder: one holder at a time among any number of processes, with a token that only grows.

Holders are files named by number, made by a create that fails if the file is there. The greatest number is the lease; it is
free when its file says so, or when its holder has not renewed it for ``seconds``. Its number is a fencing token: whoever
works under a lease asks ``valid`` before it publishes, so a holder that was taken for dead can't undo its successor's work.
Times are those of the file system, so holders' clocks need not agree.
"""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Lease:
    def __init__(self, spark: SparkSession, path: str, seconds: float = 120.0):
        self.path, self.seconds, self._hadoop, self._nio = path.rstrip("/"), seconds, spark._jvm.org.apache.hadoop.fs, spark._jvm.java.nio.file
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._file = spark._jvm.java.io.File
        self._attributes = lambda: spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []

    def _now(self) -> float:
        """The file system's time, in seconds: that of a file made just now."""
        probe = self._at(f".now-{uuid.uuid4().hex}")
        self._fs.create(probe, True).close()
        try:
            return self._fs.getFileStatus(probe).getModificationTime() / 1000
        finally:
            self._fs.delete(probe, False)

    def _create(self, path) -> None:
        """Makes a file that must not be there. Hadoop's local file system looks first and creates then, so it is not asked."""
        if self._fs.getScheme() == "file":
            self._fs.mkdirs(self._at(""))
            at = self._hadoop.Path.getPathWithoutSchemeAndAuthority(path).toString()
            self._nio.Files.createFile(self._file(at).toPath(), self._attributes())
        else:
            self._fs.create(path, False).close()

    def _last(self) -> int:
        return max((int(n) for n in self._names() if n.isdigit()), default=0)

    def acquire(self) -> int | None:
        """The token of the lease, or None while another holds it."""
        last = self._last()
        if last and f"{last}.free" not in self._names():
            renewed = self._fs.getFileStatus(self._at(str(last))).getModificationTime() / 1000
            if self._now() - renewed < self.seconds:
                return None
        try:
            self._create(self._at(str(last + 1)))
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return None
            raise
        for name in self._names():
            number = name.partition(".")[0]
            if number.isdigit() and int(number) < last:
                self._fs.delete(self._at(name), False)
        return last + 1

    def valid(self, token: int) -> bool:
        """Whether no one has taken the lease since."""
        return self._last() == token and f"{token}.free" not in self._names()

    def renew(self, token: int) -> bool:
        if not self.valid(token):
            return False
        self._fs.setTimes(self._at(str(token)), int(self._now() * 1000), -1)
        return True

    def release(self, token: int) -> None:
        if self._last() == token:
            self._fs.create(self._at(f"{token}.free"), True).close()

    @contextmanager
    def held(self):
        """The token, renewed until the end of the block, or None if another holds the lease."""
        token = self.acquire()
        if token is None:
            yield None
            return
        stop = threading.Event()

        def keep():
            while not stop.wait(self.seconds / 3) and self.renew(token):
                pass

        thread = threading.Thread(target=keep, daemon=True)
        thread.start()
        try:
            yield token
        finally:
            stop.set()
            thread.join()
            self.release(token)
