"""Small files and folder listings in the store that Spark uses, whatever it is."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Reads and writes through Hadoop's file system interface, as Spark itself does."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def names(self, folder: str) -> list[str]:
        """Sorted names in a folder; none if it does not exist."""
        at, fs = self._at(folder)
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at))

    def read(self, path: str) -> str:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file whole or not at all; False if there is one of that name already."""
        at, fs = self._at(path)
        draft, _ = self._at(f"{at.getParent().toString()}/.{uuid.uuid4().hex}")
        stream = fs.create(draft)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.exists(at) and fs.rename(draft, at):
            return True
        fs.delete(draft, False)
        return False

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)
