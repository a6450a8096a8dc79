"""Small files and folders beside the tables, through the file system of their address."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder on any file system that Spark reaches; used by the driver for listings and a few hundred bytes at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = path.rstrip("/")
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Names of what lies in the folder; none if it does not exist."""
        if not self._files.exists(self._at("")):
            return []
        return sorted(x.getPath().getName() for x in self._files.listStatus(self._at("")))

    def text(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def head(self, name: str, size: int) -> bytes:
        """The first bytes of a file."""
        stream = self._files.open(self._at(name))
        try:
            return bytes(stream.readNBytes(size))
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file under a name that is not taken; false if it is. It appears whole or not at all."""
        draft = self._at(f".{name}.draft")
        stream = self._files.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._files.exists(self._at(name)) or not self._files.rename(draft, self._at(name)):
            self._files.delete(draft, False)
            return False
        return True

    def drop(self, name: str) -> None:
        """Remove a file or folder; nothing happens if it does not exist."""
        self._files.delete(self._at(name), True)
