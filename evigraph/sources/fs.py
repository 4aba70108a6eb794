"""Small files and folders on any file system Spark can reach, by way of Hadoop's file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Existence, names, small UTF-8 texts and moves; paths may be local or of any configured scheme."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        """Sorted names in a folder; none where it is missing."""
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make(self, folder: str) -> None:
        fs, p = self._at(folder)
        fs.mkdirs(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes beside the file and renames, so a reader sees the old text or the new one."""
        fs, p = self._at(path)
        _, new = self._at(path + ".new")
        stream = fs.create(new, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        fs.delete(p, False)
        fs.rename(new, p)

    def swap(self, new: str, path: str) -> None:
        """Puts a finished table in the place of another."""
        fs, p = self._at(path)
        _, n = self._at(new)
        fs.delete(p, True)
        fs.rename(n, p)
