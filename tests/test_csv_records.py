"""Splittable CSV: equal to the one-task reader, many ranges per file, rejects."""

import csv
import io
import os
import random

import numpy as np
import pytest

from plume.session import local_fs_path
from plume.sources import csv_records as R
from plume.sources.csv_dir import POSITION, scan_csv_dir


def _write(path, name, data):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


@pytest.fixture()
def ranges_of(spark):
    """Sets the size of byte ranges; the session's own setting comes back."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {k: spark.conf.get(k) for k in keys}

    def put(size):
        for k in keys:
            spark.conf.set(k, str(size))

    yield put
    for k, v in before.items():
        spark.conf.set(k, v)


def _cells(r, n):
    alphabet = 'ab ,,""\n\né\t'
    return ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 3, 8, 30, 90]))) for _ in range(n)]


def _file(r, names, rows, end):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows([names, *rows])
    data = out.getvalue()
    return data[:-len(end)] if r.random() < 0.5 else data


def _null(x):
    return None if x in ("", "NA") else x


@pytest.mark.parametrize("seed,size", [(0, 31), (1, 150), (2, 10**6)])
def test_equals_the_csv_module_in_ranges_of_any_size(spark, scratch, ranges_of, seed, size):
    r = random.Random(seed)
    expected = []
    for k, names in enumerate((["id", "x", "y"], ["y", "id", "more", "x"], ["id", "x", "y"])):
        rows = []
        for i in range(8):
            cells = _cells(r, len(names))
            cells[names.index("id")] = f"{k}-{i}"
            rows.append(cells)
            row = dict(zip(names, cells))
            expected.append((row["id"], _null(row["x"]), _null(row["y"]), _null(row.get("more", ""))))
        _write(local_fs_path(scratch), f"f{k}.csv", _file(r, names, rows, r.choice(["\n", "\r\n"])))
    ranges_of(size)
    df = R.scan_csv_large(spark, scratch)
    if size < 100:
        assert R._scan(R._lines(spark, scratch, "*.csv")).count() > 10  # ranges in which a line begins
    assert sorted(map(tuple, df.select("id", "x", "y", "more").collect())) == sorted(expected)


def test_equals_the_one_task_reader(spark, scratch, ranges_of):
    d = local_fs_path(scratch)
    _write(d, "a.csv", 'id,text,likes\r\n1,"hello ""you""\nsecond, line",5\r\n2,NA,\r\n\r\n3,"",7\r\n4,5" pipe,6"\r\n')
    _write(d, "b.csv", 'likes,id,extra,text\n7,5,x,plain\n8,6\n"9",7,"y\n\n""z""\n",  spaces  \n')
    key = lambda row: row.id
    ranges_of(40)
    assert sorted(R.scan_csv_large(spark, scratch).collect(), key=key) == sorted(scan_csv_dir(spark, scratch).collect(), key=key)
    _write(d, "a.csv", 'id,text\r\n1,"line\r\nline"\r\n')  # the one-task reader would make \n of it
    assert {r.text for r in R.scan_csv_large(spark, scratch, pattern="a.csv").collect()} == {"line\r\nline"}


def test_many_tasks_read_one_file(spark, scratch, ranges_of):
    rows = [[str(i), f'line one of {i}\nline "two", and\n\nthree' + "x" * (i % 50)] for i in range(600)]
    _write(local_fs_path(scratch), "one.csv", _file(random.Random(1), ["id", "text"], rows, "\n"))
    ranges_of(4096)
    df = R.scan_csv_large(spark, scratch, position=True)
    assert df.rdd.getNumPartitions() > 8
    found = {r.id: (r.text, r[POSITION[1]], r[POSITION[2]]) for r in df.collect()}
    assert len(found) == 600 and all(found[i][0] == t for i, t in rows)
    with open(os.path.join(local_fs_path(scratch), "one.csv"), "rb") as f:
        data = f.read()
    for i, _ in rows[::97]:
        _, offset, line = found[i]
        assert data[offset:].split(b",")[0].strip(b'"') == i.encode() and data[:offset].count(b"\n") == line - 1


def test_rejects_have_their_place(spark, scratch, ranges_of):
    d = local_fs_path(scratch)
    _write(d, "a.csv", 'a,b\n1,x\n2,y,,z\n3,"multi\nline",\n4\n5,ok\n')
    _write(d, "b.csv", 'b,a\nx,6\n"never closed,7\nx,8\n')
    for size in (11, 10**6):
        ranges_of(size)
        rows, rejects = R.scan_csv_rejects(spark, scratch)
        assert sorted((r.a, r.b) for r in rows.collect()) == [("1", "x"), ("4", None), ("5", "ok"), ("6", "x")]
        found = sorted((os.path.basename(r.path), r.line, r.offset, r.n_cells, r.reason, r.record) for r in rejects.collect())
        assert found == [("a.csv", 3, 8, 4, R.TOO_MANY, "2,y,,z"), ("a.csv", 4, 15, 3, R.TOO_MANY, '3,"multi\nline",'),
                         ("b.csv", 3, 8, found[2][3], R.UNCLOSED, '"never closed,7\nx,8\n'.rstrip("\n"))]
        with pytest.raises(Exception, match="more cells than the header|never closed"):
            R.scan_csv_large(spark, scratch).collect()


def test_one_task_reader_raises_on_any_extra_cell(spark, scratch):
    _write(local_fs_path(scratch), "a.csv", "a,b\n1,x\n2,y,,z\n")
    for multi_line in (True, False):
        with pytest.raises(Exception, match="more cells than its header"):
            scan_csv_dir(spark, scratch, multi_line=multi_line).collect()
        with pytest.raises(Exception, match="more cells than its header"):
            scan_csv_dir(spark, scratch, multi_line=multi_line).select("a").collect()


def test_odd_folders_and_headers(spark, scratch):
    d = local_fs_path(scratch)
    os.makedirs(d, exist_ok=True)
    assert R.scan_csv_large(spark, scratch, "a string").isEmpty()
    assert R.scan_csv_large(spark, scratch + "/nowhere", "a string").columns == ["a"]
    _write(d, "empty.csv", "")
    assert R.scan_csv_rejects(spark, scratch, "a string")[1].isEmpty()
    _write(d, "a.csv", "﻿a,a,,a\n1,2,3,4\n \n")
    _write(d, "only_header.csv", "b")
    df = R.scan_csv_large(spark, scratch)
    assert sorted(df.columns) == sorted(["a", "a.1", "Unnamed: 2", "a.2", "b"])
    assert [tuple(r.asDict()[c] for c in ("a", "a.1", "Unnamed: 2", "a.2", "b")) for r in df.collect()] == [("1", "2", "3", "4", None)]
    _write(d, "broken.csv", '"two\nlines",b\n1,2\n')
    with pytest.raises(ValueError, match="line break"):
        R.scan_csv_large(spark, scratch)


def test_states_against_a_walk():
    r = random.Random(3)
    for _ in range(300):
        code = np.array([r.choice([0, 1, 2, 2, 3]) for _ in range(r.randint(0, 12))], np.int8)
        for inside in (False, True):
            state, before = inside, []
            for c in code.tolist():
                before.append(state)
                state = {0: False, 1: not state, 2: state, 3: True}[c]
            got, end = R._states(code, inside)
            assert got.tolist() == before and end == state


def test_a_very_long_cell_needs_no_recursion(spark, scratch, ranges_of):
    long = 'say ""hi"" and go on, ' * 40_000
    _write(local_fs_path(scratch), "a.csv", f'id,text\n1,"{long}\n{long}"\n2,b\n')
    ranges_of(100_000)
    rows = {r.id: r.text for r in R.scan_csv_large(spark, scratch).collect()}
    plain = long.replace('""', '"')
    assert rows == {"1": f"{plain}\n{plain}", "2": "b"}
