"""A table made once from source files and kept up to date by version.

The dashboard loads and labels its files once and then answers many questions.
Here the labelled table is a folder that any reader can open:

    data/<version>/       rows made by one refresh, with ``_source``: their file
    manifests/<version>/  one row per source file: path, size, time of change,
                          the version that holds its rows, and how many files
                          that version was made of
    CURRENT               the version to read, and those before it

``refresh`` lists the source files, makes rows of the new and changed ones
alone, writes them and a manifest, and switches ``CURRENT`` at the very end by
an atomic rename.  A refresh that dies leaves the old version readable; what it
wrote is taken away by a later ``expire``.  Rows of changed or removed files
stay in the data folder they were written to and are left out when reading.

One writer at a time; any number of readers.  All files are reached through
Spark and Hadoop's file systems.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Folder

SOURCE = "_source"
#: Versions named in CURRENT.
REMEMBERED = 100
_FILES = "path string, location string, size long, changed timestamp"


def source_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """(path, location, size, changed) of the files directly in a folder (or of
    one file): ``path`` as scans name them, ``location`` to read them by."""
    try:
        found = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
                 .option("recursiveFileLookup", "false").load(directory))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _FILES)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("path").alias("location"),
                        F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


class VersionedTable:
    """A table below ``path`` made by ``make(locations)``: a DataFrame of the
    rows of these source files, with the column ``_source`` (the scan's
    ``_metadata.file_path``)."""

    def __init__(self, spark: SparkSession, path: str, make: Callable[[list[str]], DataFrame]) -> None:
        self.spark, self.path, self.make = spark, path.rstrip("/"), make
        self._folder = Folder(spark, path)

    def versions(self) -> list[str]:
        """The versions there have been, the one to read first."""
        return (self._folder.text("CURRENT") or "").split(",") if self._folder.exists("CURRENT") else []

    def current(self) -> str | None:
        """The version to read; None before the first refresh."""
        return next(iter(self.versions()), None)

    def _next(self) -> str:
        """A name no refresh has used: larger than all, and unlike a rival's."""
        used = [int(m[1]) for n in [*self._folder.names("data"), *self._folder.names("manifests")] if (m := re.match(r"(\d+)-", n))]
        return f"{max(used, default=0) + 1:09d}-{uuid.uuid4().hex[:8]}"

    def refresh(self, directory: str, pattern: str = "*") -> tuple[str, int]:
        """The version for the files that are there now, and how many files were
        read for it; without a change, the current one and 0."""
        spark = self.spark
        files = source_files(spark, directory, pattern)
        version = self.current()
        known = self._manifest(version) if version else None
        if known is None:
            changed = files
        else:
            same = ["path", "size", "changed"]
            changed = files.join(known.select(*same), same, "left_anti")
            gone = not known.join(files.select(*same), same, "left_anti").isEmpty()
        locations = [r.location for r in changed.select("location").collect()]  # the driver lists them for the scan, too
        if known is not None and not locations and not gone:
            return version, 0
        new = self._next()
        manifest = changed.withColumn("version", F.lit(new)).withColumn("files", F.lit(len(locations)))
        if known is not None:
            manifest = manifest.unionByName(known.join(files.select(*same), same, "left_semi"))
        manifest = manifest.checkpoint(eager=True)  # what the rows are made of, whatever happens to the folder meanwhile
        if locations:
            self.make(locations).write.parquet(f"{self.path}/data/{new}")
        manifest.write.parquet(f"{self.path}/manifests/{new}")
        self._folder.put("CURRENT", ",".join([new, *self.versions()][:REMEMBERED]))
        return new, len(locations)

    def expire(self, keep: int = 2) -> list[str]:
        """Delete all manifests but those of the last ``keep`` versions, the data
        that these don't need, and what dead refreshes left."""
        kept = self.versions()[:keep]
        if not kept:
            return []
        needed = {r.version for n in kept for r in self._manifest(n).select("version").distinct().collect()}
        old = [f"manifests/{n}" for n in self._folder.names("manifests") if n not in kept]
        old += [f"data/{n}" for n in self._folder.names("data") if n not in needed]
        for folder in old:
            self._folder.delete(folder)
        return old

    def _manifest(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifests/{version}")

    def read(self, version: str | None = None) -> DataFrame | None:
        """The rows of a version (the current one); None if there is none.  Only
        the columns a query uses are read; the rows' files are compared with the
        manifest only where a data folder holds rows of files since changed."""
        version = version or self.current()
        if version is None:
            return None
        manifest = self._manifest(version).select("path", "version", "files").checkpoint(eager=True)
        held = manifest.groupBy("version").agg(F.count(F.lit(1)).alias("live"), F.max("files").alias("files")).collect()
        if not held:
            return None
        # a folder all of whose files are as they were is read as it stands
        whole = sorted(r.version for r in held if r.live == r.files)
        parts = [self.spark.read.parquet(*(f"{self.path}/data/{v}" for v in whole))] if whole else []
        for v in sorted(r.version for r in held if r.live < r.files):
            live = manifest.filter(F.col("version") == v).select(F.col("path").alias(SOURCE))
            parts.append(self.spark.read.parquet(f"{self.path}/data/{v}").join(live, SOURCE, "left_semi"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out
