"""The table behind a trend stream, kept small however long the stream runs.

Every micro-batch brings the new counts of the windows it changed.  Windows that
may still change live in ``open/``: each batch writes all of them anew, merged
with its own, so there is one such folder to read.  A window that ends before
the latest window's start less the watermark's delay is *closed*: it moves once
to ``closed/``.  Closed folders are merged ``FAN`` at a time, and so are the
merged ones, so their number grows with the logarithm of the batches.

Every row carries the batch it is from, and a window's count is the one of its
latest batch; a batch that is run again after a failure reads what its
predecessor left, writes the same folders over, and changes nothing.  A merged
folder hides the folders it was made from, whether they are still there or not.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Folder

FAN = 8
_CLOSED = re.compile(r"(\d+)-(\d+)-(\d+)$")  # level, first batch, last batch
_OPEN = re.compile(r"(\d+)$")


class WindowTable:
    """Counts per window and ``key`` below ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "event_type", watermark: str = "1 hour") -> None:
        self.spark, self.path, self.key, self.watermark = spark, path.rstrip("/"), key, watermark
        self._folder = Folder(spark, path)
        self._columns = ["window_start", "window_end", key]

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Per window the count of its latest batch."""
        found = rows.groupBy(*self._columns).agg(F.max(F.struct("batch_id", "count")).alias("last"))
        return found.select(*self._columns, F.col("last.count").alias("count"), F.col("last.batch_id").alias("batch_id"))

    def _read(self, *names: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{n}" for n in names))

    def _open_before(self, batch_id: int) -> str | None:
        found = [int(m[1]) for n in self._folder.names("open") if (m := _OPEN.match(n))]
        done = [b for b in found if b < batch_id and self._folder.written(f"open/{b:012d}")]
        return f"open/{max(done):012d}" if done else None

    def _closed(self, upto: int) -> list[tuple[int, int, int]]:
        """The closed folders that count: written to the end, of batches up to
        ``upto``, and not hidden by a merged one; (level, first, last)."""
        found = [tuple(map(int, m.groups())) for n in self._folder.names("closed") if (m := _CLOSED.match(n))]
        found = [f for f in found if f[2] <= upto and self._folder.written(self._name(f))]
        return sorted(f for f in found if not any(g[0] > f[0] and g[1] <= f[1] and f[2] <= g[2] for g in found))

    @staticmethod
    def _name(folder: tuple[int, int, int]) -> str:
        return "closed/{}-{:012d}-{:012d}".format(*folder)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Take up a micro-batch: window_start, window_end, the key and count."""
        # written first: from here on it is an ordinary table, planned adaptively
        changed = f"changed/{batch_id:012d}"
        batch.select(*self._columns, "count", F.lit(batch_id).cast("long").alias("batch_id")) \
             .write.mode("overwrite").parquet(f"{self.path}/{changed}")
        before = self._open_before(batch_id)
        merged = self._latest(self._read(changed, *([before] if before else [])))
        last = merged.agg(F.max("window_start").alias("last")).first().last
        ends = F.coalesce(F.col("window_end") <= F.lit(last) - F.expr(f"INTERVAL {self.watermark}"), F.lit(False))
        closing = merged.filter(ends)
        if not closing.isEmpty():
            closing.write.mode("overwrite").parquet(f"{self.path}/{self._name((0, batch_id, batch_id))}")
        merged.filter(~ends).write.mode("overwrite").parquet(f"{self.path}/open/{batch_id:012d}")
        # a replay of this batch needs the open folder before it, no earlier one
        for n in self._folder.names("open"):
            if _OPEN.match(n) and f"open/{n}" < (before or ""):
                self._folder.delete(f"open/{n}")
        self._folder.delete(changed)
        self._merge(batch_id)

    def _merge(self, upto: int) -> None:
        level = 0
        while True:
            folders = [f for f in self._closed(upto) if f[0] == level]
            if len(folders) < FAN:
                break
            whole = (level + 1, folders[0][1], folders[-1][2])
            self._latest(self._read(*map(self._name, folders))).write.mode("overwrite").parquet(f"{self.path}/{self._name(whole)}")
            level += 1
        counting = set(self._closed(upto))
        for n in self._folder.names("closed"):
            if (m := _CLOSED.match(n)) and int(m[3]) <= upto and tuple(map(int, m.groups())) not in counting:
                self._folder.delete(f"closed/{n}")

    def read(self) -> DataFrame | None:
        """(window_start, window_end, key, count) as of the last batch; None
        before the first."""
        last = self._open_before(1 << 62)
        if last is None:
            return None
        folders = self._closed(int(last.rsplit("/", 1)[1]))
        return self._latest(self._read(last, *map(self._name, folders))).drop("batch_id")
