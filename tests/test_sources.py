"""CSV directory by name, NA tokens, empty source, Parquet file sizes."""

import os

import pytest
from pyspark.sql import functions as F

from plume.session import local_fs_path
from plume.sources.csv_dir import POSITION, scan_csv_dir
from plume.sources.sinks import file_row_counts, write_parquet_chunks


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_scan_csv_dir_matches_columns_by_name(spark, scratch):
    d = local_fs_path(scratch)
    _write(d, "a.csv", 'id,text,likes\n1,"hello ""you""\nsecond line",5\n2,NA,\n')
    _write(d, "b.csv", "likes,id,extra,text\n7,3,x,plain\n")
    _write(d, "notes.txt", "not,a,csv\n")
    os.makedirs(os.path.join(d, "sub"), exist_ok=True)
    _write(os.path.join(d, "sub"), "c.csv", "id,text\n9,nested\n")
    rows = {r.id: r for r in scan_csv_dir(spark, scratch).collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["1"].text == 'hello "you"\nsecond line' and rows["1"].likes == "5"
    assert rows["2"].text is None and rows["2"].likes is None and rows["2"].extra is None
    assert rows["3"].text == "plain" and rows["3"].likes == "7" and rows["3"].extra == "x"


def test_scan_empty_dir_gives_empty_table(spark, scratch):
    d = local_fs_path(scratch)
    os.makedirs(d, exist_ok=True)
    df = scan_csv_dir(spark, scratch, schema="textOriginal string")
    assert df.isEmpty() and df.columns == ["textOriginal"]


def test_missing_dir_gives_empty_table(spark, scratch):
    assert scan_csv_dir(spark, scratch + "/nowhere", schema="a string").isEmpty()


def test_cells_beyond_the_header_raise_and_short_rows_are_filled(spark, scratch):
    d = local_fs_path(scratch)
    _write(d, "a.csv", "id,text\n1,x\n2\n")
    assert {(r.id, r.text) for r in scan_csv_dir(spark, scratch).collect()} == {("1", "x"), ("2", None)}
    _write(d, "b.csv", "id,text\n3,y,EXTRA\n")
    with pytest.raises(Exception, match="more cells than its header"):
        scan_csv_dir(spark, scratch).collect()


def test_broken_header_raises(spark, scratch):
    _write(local_fs_path(scratch), "a.csv", '"two\nlines",b\n1,2\n')
    with pytest.raises(ValueError, match="line break"):
        scan_csv_dir(spark, scratch)


def test_file_lost_after_listing_raises(spark, scratch):
    d = local_fs_path(scratch)
    _write(d, "a.csv", "id\n1\n")
    _write(d, "b.csv", "id\n2\n")
    df = scan_csv_dir(spark, scratch)
    os.remove(os.path.join(d, "b.csv"))
    with pytest.raises(Exception):
        df.collect()


@pytest.mark.parametrize("multi_line", [True, False])
def test_ties_go_by_file_and_position(spark, scratch, multi_line):
    d = local_fs_path(scratch)
    _write(d, "b.csv", "id,likes\nb1,5\nb2,5\n")
    _write(d, "a.csv", "likes,id\n5,a1\n9,a2\n5,a3\n")
    df = scan_csv_dir(spark, scratch, multi_line=multi_line, position=True)
    top = df.orderBy(F.desc(F.col("likes").cast("int")), *POSITION).limit(4)
    assert [r.id for r in top.collect()] == ["a2", "a1", "a3", "b1"]


def test_parquet_chunks_bound_rows_per_file(spark, scratch):
    write_parquet_chunks(spark.range(25000).repartition(1), scratch, rows_per_file=10000)
    sizes = sorted(r.rows for r in file_row_counts(spark, scratch).collect())
    assert sizes == [5000, 10000, 10000]


def test_exact_chunks_hold_their_number_of_rows(spark, scratch):
    from plume.sources.sinks import write_parquet_exact

    for n, parts in ((25_000, 7), (3_000, 5), (1_000, 1), (999, 40), (0, 2)):
        df = spark.range(n).selectExpr("id", "id AS chunk", "'x' AS `a.b`").repartition(parts)
        out = f"{scratch}-{n}"
        write_parquet_exact(df, out, rows_per_file=1000)
        back = spark.read.parquet(out)
        assert back.columns == df.columns and back.count() == n == back.select("id").distinct().count()
        sizes = sorted((r.rows for r in file_row_counts(spark, out).collect()), reverse=True)
        assert [s for s in sizes if s] == [1000] * (n // 1000) + ([n % 1000] if n % 1000 else [])
