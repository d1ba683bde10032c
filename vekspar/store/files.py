"""Files of a collection through Hadoop's file system API, so any shared storage works."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..errors import FailedPrecondition


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file, whole or not at all: a temporary one takes the name when it is complete. Nothing is ever replaced."""
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(temporary), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(name) or not self._fs.rename(self._path(temporary), self._path(name)):
            self.delete(temporary)
            raise FailedPrecondition(f"{name} could not be published", path=self.root)

    def sizes(self, name: str) -> dict[str, int]:
        """The data files below a folder, by their names, with their lengths."""
        found, files = {}, self._fs.listFiles(self._path(name), True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                found[f.getPath().toString().rpartition(f"/{name}/")[2]] = f.getLen()
        return found

    def claim(self, name: str) -> bool:
        """Create a file that must not exist."""
        self._fs.mkdirs(self._path(""))
        return self._fs.createNewFile(self._path(name))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(name))] if self.exists(name) else []
