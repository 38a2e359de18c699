"""The few file operations that a commit needs, through Hadoop's file systems."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and Spark runs inside one process (tests), a
    temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Files:
    """Paths below a root on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        path = self._path(root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(path).toString().rstrip("/")
        self.local = self.root.startswith("file:")

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.at(name))))

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(self.at(name)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str, sync: bool = True) -> bool:
        """Write a file that must not exist yet, whole or not at all; False if another writer was first."""
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(self.at(temporary)), False)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync() if sync else stream.hflush()
        finally:
            stream.close()
        try:
            if self.local:  # a link fails if the name is taken, a rename would replace it
                plain = lambda n: self._path(self.at(n)).toUri().getPath()
                os.link(plain(temporary), plain(name))
                return True
            return bool(self.fs.rename(self._path(self.at(temporary)), self._path(self.at(name))))
        except FileExistsError:
            return False
        finally:
            self.fs.delete(self._path(self.at(temporary)), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)

    def move(self, to: "Files") -> None:
        """Everything below this root to another root, where nothing is."""
        if not self.fs.rename(self._path(self.root), self._path(to.root)):
            raise OSError(f"{self.root} can't be moved to {to.root}")

    def size(self, *names: str) -> int:
        return sum(self.fs.getContentSummary(self._path(self.at(n))).getLength() for n in names)

    def sync(self, names: list[str]) -> None:
        """Local files to disk; other file systems have done so when a file was closed."""
        if not self.local:
            return
        for name in names:
            path = self._path(self.at(name)).toUri().getPath()
            for at in (path, os.path.dirname(path)):
                handle = os.open(at, os.O_RDONLY)
                try:
                    os.fsync(handle)
                finally:
                    os.close(handle)
