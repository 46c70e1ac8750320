"""A store's folder through Hadoop's file system API: works on any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """Small files of a folder on the driver: manifests, pointers and locks. Data goes through Spark's writers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def create_exclusive(self, name: str, text: str = "") -> bool:
        """False if it exists."""
        try:
            out = self._fs.create(self._path(name), False)
            try:
                out.write(bytearray(text.encode()))
            finally:
                out.close()
        except Exception as e:  # noqa: BLE001 - the JVM's exception type comes through py4j
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside and renamed."""
        temp = self._path(f"{name}.dbtmp")
        out = self._fs.create(temp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        # one step that replaces: a reader sees the old text or the new one
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        whole = self._fs.makeQualified(temp)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(whole, self._fs.makeQualified(self._path(name)), options)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.hadoop.thirdparty.com.google.common.io.ByteStreams.toByteArray(stream)).decode()
        finally:
            stream.close()
