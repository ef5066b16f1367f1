"""Small files in whatever store Spark's paths name: commit files and manifests."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Names, small texts and deletion by the file system that Spark itself uses for a path; for the driver."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def names(self, folder: str) -> list[str]:
        """What a folder holds, sorted; nothing where it does not exist."""
        store, at = self._open(folder)
        return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []

    def size(self, path: str) -> int:
        """Bytes of a file, or of a folder with all in it."""
        store, at = self._open(path)
        return store.getContentSummary(at).getLength() if store.exists(at) else 0

    def read(self, path: str) -> str:
        store, at = self._open(path)
        stream = store.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Writes a new file, and fails where there is one already."""
        store, at = self._open(path)
        stream = store.create(at, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        store, at = self._open(path)
        store.delete(at, True)
