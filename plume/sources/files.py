"""Small file operations on any file system Spark reaches (Hadoop's client on
the driver): folders of intermediate tables, pointer files."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder and what lies directly in it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._jvm.Path(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """Names in a folder below, sorted; none if it is not there."""
        path = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def written(self, name: str) -> bool:
        """Whether a table below was written to its end."""
        return self.exists(f"{name}/_SUCCESS")

    def delete(self, name: str = "") -> None:
        """Remove a file or folder below (or this one); nothing if it is gone."""
        self._fs.delete(self._at(name), True)

    def text(self, name: str) -> str | None:
        """The first line of a small file below; None if it is not there."""
        return self.spark.read.text(self._at(name).toString()).first().value if self.exists(name) else None

    def put(self, name: str, text: str) -> None:
        """Replace a small file below, by one atomic rename."""
        fresh = self._at(f".{name}-{uuid.uuid4().hex}")
        out = self._fs.create(fresh)
        out.writeBytes(text)
        out.close()
        source, target = self._fs.makeQualified(fresh), self._fs.makeQualified(self._at(name))
        options = self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 1)
        options[0] = self._jvm.Options.Rename.OVERWRITE
        self._jvm.FileContext.getFileContext(target.toUri(), self._conf).rename(source, target, options)
