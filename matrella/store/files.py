"""Small files next to the data, through Spark's own file system layer, so any storage that the cluster reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession

from matrella.errors import ConflictError


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, uri: str):
        path = self.jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.conf), path

    def exists(self, uri: str) -> bool:
        fs, path = self._at(uri)
        return fs.exists(path)

    def names(self, uri: str) -> list[str]:
        fs, path = self._at(uri)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, uri: str) -> str:
        fs, path = self._at(uri)
        stream = fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, uri: str, text: str) -> None:
        """Write a file that must not be there yet."""
        fs, path = self._at(uri)
        try:
            stream = fs.create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise ConflictError(uri) from None
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def folder(self, uri: str) -> None:
        fs, path = self._at(uri)
        fs.mkdirs(path)

    def move(self, uri: str, to: str) -> None:
        """Rename a folder into another one, which is made if need be."""
        fs, path = self._at(uri)
        target = self.jvm.org.apache.hadoop.fs.Path(to)
        fs.mkdirs(target.getParent())
        if not fs.rename(path, target):
            raise ConflictError(to)

    def delete(self, uri: str) -> None:
        fs, path = self._at(uri)
        fs.delete(path, True)
