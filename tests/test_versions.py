"""The load-once table: only changed files are read, a dead refresh harms nothing."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from plume.session import local_fs_path
from plume.sources.files import Folder
from plume.sources.versions import SOURCE, VersionedTable


class Source:
    """A folder of one-file tables, and a record of what was read."""

    def __init__(self, spark, base):
        self.spark, self.base, self.read, self.fail = spark, local_fs_path(base), [], None
        self.dir = os.path.join(self.base, "in")
        os.makedirs(self.dir)
        self.clock = 1_700_000_000

    def put(self, name, values):
        tmp = os.path.join(self.base, f"tmp{self.clock}")
        self.spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).write.parquet(tmp)
        part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
        target = os.path.join(self.dir, name)
        shutil.copy(os.path.join(tmp, part), target)
        crc = os.path.join(self.dir, f".{name}.crc")
        if os.path.exists(crc):
            os.remove(crc)
        self.clock += 100
        os.utime(target, (self.clock, self.clock))

    def make(self, locations):
        self.read.append(sorted(os.path.basename(x) for x in locations))
        rows = self.spark.read.parquet(*locations).select("v", (F.col("v") * 10).alias("ten"), F.col("_metadata.file_path").alias(SOURCE))
        if self.fail:
            rows = rows.filter(F.when(F.col("v") == self.fail, F.raise_error(F.lit("lost")).cast("boolean")).otherwise(True))
        return rows


@pytest.fixture()
def source(spark, scratch):
    return Source(spark, scratch)


def values(table, version=None):
    df = table.read(version)
    return None if df is None else sorted(r.ten for r in df.collect())


def test_only_new_and_changed_files_are_read(spark, source):
    table = VersionedTable(spark, os.path.join(source.base, "table"), source.make)
    assert table.current() is None and values(table) is None and table.expire() == []
    assert table.refresh(source.dir, "*.parquet")[1] == 0 and values(table) is None  # an empty folder
    source.put("a b.parquet", [1, 2])
    source.put("b.parquet", [3])
    first, n = table.refresh(source.dir, "*.parquet")
    assert n == 2 and values(table) == [10, 20, 30]
    assert table.refresh(source.dir, "*.parquet") == (first, 0)
    source.put("c.parquet", [4])
    source.read.clear()
    assert table.refresh(source.dir, "*.parquet")[1] == 1
    assert source.read == [["c.parquet"]] and values(table) == [10, 20, 30, 40]
    source.put("a b.parquet", [7])  # changed: its old rows go
    os.remove(os.path.join(source.dir, "b.parquet"))
    source.read.clear()
    last, n = table.refresh(source.dir, "*.parquet")
    assert n == 1 and source.read == [["a b.parquet"]] and values(table) == [40, 70]
    assert values(table, first) == [10, 20, 30]  # old versions stay readable until they expire
    gone = table.expire(keep=1)
    assert f"manifests/{first}" in gone and f"data/{first}" in gone
    assert values(table) == [40, 70] and table.expire(keep=1) == []
    os.remove(os.path.join(source.dir, "c.parquet"))
    assert table.refresh(source.dir, "*.parquet")[1] == 0 and values(table) == [70]
    os.remove(os.path.join(source.dir, "a b.parquet"))
    assert table.refresh(source.dir, "*.parquet")[1] == 0 and values(table) is None


def test_a_dead_refresh_leaves_the_old_version(spark, source, monkeypatch):
    table = VersionedTable(spark, os.path.join(source.base, "table"), source.make)
    source.put("a.parquet", [1])
    first, _ = table.refresh(source.dir)
    source.put("b.parquet", [2, 3])
    source.fail = 3
    with pytest.raises(Exception, match="lost"):
        table.refresh(source.dir)
    assert table.current() == first and values(table) == [10]
    source.fail = None
    with monkeypatch.context() as m:  # dies after all is written, before the switch
        m.setattr(Folder, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            table.refresh(source.dir)
    assert table.current() == first and values(table) == [10]
    second, n = table.refresh(source.dir)
    assert n == 1 and values(table) == [10, 20, 30]
    left = set(os.listdir(os.path.join(source.base, "table", "data")))
    table.expire(keep=2)
    assert left - set(os.listdir(os.path.join(source.base, "table", "data"))) and values(table) == [10, 20, 30]
    assert values(table, first) == [10]


def test_tiles_read_only_their_columns(spark, source):
    table = VersionedTable(spark, os.path.join(source.base, "table"), source.make)
    source.put("a.parquet", [1])
    source.put("b.parquet", [2])
    table.refresh(source.dir)
    plan = table.read().agg(F.sum("ten"))._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "ten" in schema and "v:" not in schema and SOURCE not in schema
    assert "Join" not in plan
