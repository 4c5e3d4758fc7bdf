"""Small files on any file system that Spark can reach."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, a: str, b: str) -> bool:
        fs, p = self._at(a)
        to = self._jvm.org.apache.hadoop.fs.Path(b)
        fs.mkdirs(to.getParent())
        return fs.rename(p, to)

    def write_text(self, path: str, text: str) -> None:
        """Written beside and renamed, so a reader never sees half a file."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        beside = self._jvm.org.apache.hadoop.fs.Path(path + ".part")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(p, False)
        fs.rename(beside, p)

    def claim(self, path: str) -> bool:
        """Creates a file that must not exist yet; False if another was first."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        try:
            fs.create(p, False).close()
        except Exception:
            if fs.exists(p):
                return False
            raise
        return True

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def read_json(self, path: str) -> Any:
        return json.loads(self.read_text(path))

    def stamp(self, path: str) -> list:
        """[name, size, last change] of a file or of all files below a folder: what a table was built from."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        status = fs.getFileStatus(p)
        if not status.isDirectory():
            return [[p.getName(), status.getLen(), status.getModificationTime()]]
        found = []
        for s in fs.listStatus(p):
            found += [[f"{p.getName()}/{n}", size, at] for n, size, at in self.stamp(s.getPath().toString())]
        return sorted(found)
