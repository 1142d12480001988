"""CSV files with quoted line breaks, read by many tasks each.

``spark.read.csv`` must read a file in one task as soon as quoted cells may
hold line breaks (``multiLine``).  Here files are cut into Spark's own byte
ranges, and records are found in three steps:

1. *Scan.*  Spark's text source gives the physical lines of each range.  Two
   patterns say, natively, in which state (between records, or inside a quoted
   cell) a line ends for either state it may begin in.  These small functions
   compose, so each range is worked through for both start states at once and
   leaves one row: its function, its lines and its bytes.
2. *Prefix.*  One row per range, in file order: the state, line number and byte
   offset that every range begins with.
3. *Cut.*  The ranges are read again; the lines that begin between records
   begin a record, and lines up to the next such line are joined.  A record
   that crosses the end of a range leaves its parts in the ranges; parts are
   put together by (file, range where it began).  Only if some range begins
   inside a record, the files are read once more for these parts.

Cells come from Spark's ``from_csv``, all headers in one pass, and are matched
by column name; pandas' missing-value tokens become null.

A record with more cells than its header, or a quoted cell that is never
closed, is *rejected*: it raises, or goes to a table with its file, line and
byte offset.  Shorter records are filled with nulls; blank lines are skipped;
records end at ``\\n`` or ``\\r\\n`` (inside quotes both stay as they are); a repeated column name gets ``.1``, ``.2``
behind it and an empty one is ``Unnamed: i``.

Scale: no text is shuffled except the parts of records that cross a range.  The
rows per range are held on the driver and broadcast: as many as Spark has scan
tasks' ranges there anyway.  The passes must see the same ranges; if a changed
number of cores (small inputs only, else the range size is
``spark.sql.files.maxPartitionBytes``) or a changed file moves them, the read
fails and is to be repeated, rather than mix them up.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import NA_TOKENS
from ..session import ship_package
from .csv_dir import CELL, CELLS, POSITION, list_csv_files

_CLOSED = rf"\A{CELL}(?:,{CELL})*+\z"
_CLOSED_INSIDE = rf'\A(?:[^"]++|"")*+"[^,]*+(?:,{CELL})*+\z'
TOO_MANY, UNCLOSED = "more cells than the header", "a quoted cell is never closed"
#: A line's function by code: what it makes of (between records, inside a cell).
_BETWEEN, _SWAP, _SAME, _INSIDE = 0, 1, 2, 3


class Range(NamedTuple):
    """What a byte range begins with."""

    inside: bool
    line: int
    offset: int
    opener: int  # the range in which the record that goes on here began
    header: int


def _lines(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """(path, file, at, size, value, code): the physical lines in reading order
    within each range; ``at`` and ``size`` tell the range."""
    lines = (spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "false").text(directory))
    quoted = F.instr("value", '"') > 0
    ends_inside = quoted & ~F.col("value").rlike(_CLOSED)
    stays_inside = ~quoted | ~F.col("value").rlike(_CLOSED_INSIDE)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_block_length").alias("size"),
        F.col("value").cast("binary").alias("value"),
        (ends_inside.cast("int") + stays_inside.cast("int") * 2).cast("tinyint").alias("code"))


def _states(code: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """The state before every line (true: inside a cell), and the one behind
    the last: the last line that fixes the state, and the swaps since."""
    fixes = (code == _BETWEEN) | (code == _INSIDE)
    swaps = np.concatenate([[0], np.cumsum(code == _SWAP)])
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(fixes, np.arange(len(code)), -1))]).astype(np.int64)
    known = last >= 0
    base = np.where(known, code[np.maximum(last, 0)] == _INSIDE, inside) if len(code) else np.array([inside])
    since = swaps - np.where(known, swaps[np.maximum(last + 1, 0)], 0)
    state = base ^ (since % 2 == 1)
    return state[:-1], bool(state[-1])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], int, int]]:
    """(range, first row, past the last row) of neighbouring rows of one range."""
    keys = [batch.column(c).to_numpy() for c in ("file", "at", "size")]
    change = np.zeros(batch.num_rows, bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    edges = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield tuple(int(k[a]) for k in keys), a, b


def _line_sizes(values: pa.Array) -> np.ndarray:
    return pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _scan(lines: DataFrame) -> DataFrame:
    """One row per range: its lines, bytes, the state behind it and whether a
    record begins in it for either state before it, and a file's first line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            code, sizes = batch.column("code").to_numpy(), batch.column("bytes").to_numpy()
            for key, a, b in _runs(batch):
                if held is None or held[0] != key:
                    if held is not None:
                        yield _range_row(held)
                    first = batch.column("first")[a].as_py() if key[1] == 0 else None
                    held = [key, batch.column("path")[a].as_py(), 0, 0, False, True, False, False, first]
                held[2] += b - a
                held[3] += int(sizes[a:b].sum())
                for end, begins, state in ((4, 6, held[4]), (5, 7, held[5])):
                    before, held[end] = _states(code[a:b], state)
                    held[begins] |= not before.all()
        if held is not None:
            yield _range_row(held)

    wanted = lines.select("path", "file", "at", "size", "code", (F.octet_length("value").cast("long") + 1).alias("bytes"),
                          F.when(F.col("at") == 0, F.col("value")).alias("first"))
    return wanted.mapInArrow(run, _RANGE_SCHEMA)


_RANGE_SCHEMA = ("file long, at long, size long, path string, lines long, bytes long, ends boolean, ends_inside boolean, "
                 "begins boolean, begins_inside boolean, first binary")


def _range_row(held: list) -> pa.RecordBatch:
    values = [*held[0], *held[1:]]
    types = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.bool_()] * 4 + [pa.binary()]
    names = [part.split()[0] for part in _RANGE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)


def header_names(line: bytes) -> list[str]:
    """Column names of a header line."""
    text = line.decode("utf-8", "replace").lstrip("﻿").rstrip("\r")
    if text.count('"') % 2:
        raise ValueError(f"a header cell holds a line break: {text!r}")
    cells, seen, names = next(csv.reader(io.StringIO(text)), []), {}, []
    for i, cell in enumerate(cells):
        cell = cell or f"Unnamed: {i}"
        n = seen[cell] = seen.get(cell, -1) + 1
        names.append(f"{cell}.{n}" if n else cell)
    return names


def _prefix(rows: list[T.Row]) -> tuple[dict[tuple[int, int, int], Range], list[list[str]], dict[int, str], bool]:
    """What every range begins with, the distinct headers, the files, and
    whether any range ends inside a record."""
    paths: dict[int, str] = {}
    for r in rows:
        if paths.setdefault(r.file, r.path) != r.path:
            raise ValueError(f"two files share a hash: {paths[r.file]} and {r.path}")
    lines = sorted({r["first"] for r in rows if r.at == 0})
    headers = [header_names(x) for x in lines]
    number = {x: i for i, x in enumerate(lines)}
    begins: dict[tuple[int, int, int], Range] = {}
    file, crossed = None, False
    for r in sorted(rows, key=lambda r: (r.path, r.at)):
        if r.file != file:
            file, now = r.file, Range(False, 1, 0, 0, number[r["first"]])
        begins[r.file, r.at, r.size] = now
        opener = r.at if (r.begins_inside if now.inside else r.begins) else now.opener
        now = Range(r.ends_inside if now.inside else r.ends, now.line + r.lines, now.offset + r.bytes, opener, now.header)
        crossed |= now.inside
    return begins, headers, paths, crossed


class _Open:
    """A record, or the part of one that began in an earlier range, whose last
    line has not been seen."""

    def __init__(self, line: int, offset: int, part: bool) -> None:
        self.line, self.offset, self.part, self.lines = line, offset, part, []


_CUT_SCHEMA = "file long, header int, line long, offset long, opener long, at long, closed boolean, record binary"
_CUT_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
_CUT_NAMES = [part.split()[0] for part in _CUT_SCHEMA.split(", ")]


def _cut(lines: DataFrame, shared, parts: bool) -> DataFrame:
    """The records that begin and end in one range, or (``parts``) the parts of
    the others: ``opener`` is the range where it began, ``closed`` its end."""
    def rows(key, begin: Range, found: list[tuple]) -> pa.RecordBatch:
        # found: (line, offset, opener or None, closed, record)
        n = len(found)
        columns = [[key[0]] * n, [begin.header] * n, [f[0] for f in found], [f[1] for f in found],
                   [f[2] for f in found], [key[1]] * n, [f[3] for f in found], [f[4] for f in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CUT_TYPES)], _CUT_NAMES)

    def finish(key, begin: Range, open_: _Open | None, inside: bool) -> list[tuple]:
        """The open record at the end of its last line, or of the range."""
        if open_ is None or not open_.lines:
            return []
        whole = not open_.part and not inside
        if whole == parts:
            return []
        opener = None if whole else begin.opener if open_.part else key[1]
        return [(open_.line, open_.offset, opener, not inside, b"\n".join(open_.lines))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        key = begin = open_ = None
        inside, line, offset = False, 0, 0
        for batch in batches:
            for new, a, b in _runs(batch) if batch.num_rows else ():
                if new != key:
                    if key is not None and (left := finish(key, begin, open_, inside)):
                        yield rows(key, begin, left)
                    if new not in ranges:
                        raise ValueError("the byte ranges changed between the passes; read the files again")
                    key, begin = new, ranges[new]
                    inside, line, offset = begin.inside, begin.line, begin.offset
                    open_ = _Open(line, offset, True) if inside else None
                values = batch.column("value").slice(a, b - a)
                before, behind = _states(batch.column("code").to_numpy()[a:b], inside)
                places = offset + np.concatenate([[0], np.cumsum(_line_sizes(values))])
                starts = np.flatnonzero(~before)
                first = int(starts[0]) if len(starts) else len(values)
                if open_ is not None:
                    open_.lines += values.slice(0, first).to_pylist()
                if len(starts):
                    if left := finish(key, begin, open_, False):
                        yield rows(key, begin, left)
                    last = int(starts[-1])
                    if len(starts) > 1 and not parts:
                        joined = pc.binary_join(pa.ListArray.from_arrays(
                            pa.array((starts - first).astype(np.int32)), values.slice(first, last - first)), b"\n")
                        n = len(joined)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, key[0])), pa.array(np.full(n, begin.header, np.int32)), pa.array(line + starts[:-1]),
                             pa.array(places[starts[:-1]]), pa.nulls(n, pa.int64()), pa.array(np.full(n, key[1])),
                             pa.array(np.ones(n, bool)), joined], _CUT_NAMES)
                    open_ = _Open(line + last, int(places[last]), False)
                    open_.lines = values.slice(last).to_pylist()
                inside, line, offset = behind, line + len(values), int(places[-1])
        if key is not None and (left := finish(key, begin, open_, inside)):
            yield rows(key, begin, left)

    return lines.select("file", "at", "size", "code", "value").mapInArrow(run, _CUT_SCHEMA)


def _joined(parts: DataFrame) -> DataFrame:
    """The parts of each record in file order, as one record."""
    part = F.struct("at", "line", "offset", "header", "closed", F.col("record").cast("string").alias("record"))
    whole = parts.groupBy("file", "opener").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # of one record
    first = F.col("parts")[0]
    return whole.select("file", first["header"].alias("header"), first["line"].alias("line"), first["offset"].alias("offset"),
                        F.exists("parts", lambda p: p["closed"]).alias("closed"),
                        F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))


def read_records(spark: SparkSession, directory: str, pattern: str = "*.csv") -> tuple[DataFrame, list[list[str]], DataFrame] | None:
    """(file, header, line, offset, record, n_cells, reason) of every record of
    the files in ``directory``, the headers, and (file, path); None if there is
    no file with a header.  ``reason`` is null for a good record."""
    files = list_csv_files(spark, directory, pattern)
    if files is None or files.isEmpty():
        return None
    ship_package(spark)
    lines = _lines(spark, directory, pattern)
    begins, headers, paths, crossed = _prefix(_scan(lines).collect())  # a row per byte range
    if not begins:
        return None
    shared = spark.sparkContext.broadcast(begins)
    kept = ["file", "header", "line", "offset", "closed", "record"]
    records = _cut(lines, shared, parts=False).withColumn("record", F.col("record").cast("string")).select(*kept)
    if crossed:
        records = records.unionByName(_joined(_cut(lines, shared, parts=True)).select(*kept))
    records = records.filter(F.col("line") > 1)
    record = F.regexp_replace("record", r"\r\z", "")
    records = records.withColumn("record", F.when(F.col("record").endswith("\r"), record).otherwise(F.col("record")))
    records = records.filter(F.col("record").rlike(r"[^\s]"))
    width = F.element_at(F.array(*(F.lit(len(h)) for h in headers)), F.col("header") + 1)
    # a record without a quote is cut at its commas
    cells = F.when(F.instr("record", '"') > 0, F.regexp_count("record", F.lit(CELLS))) \
             .otherwise(F.length("record") - F.length(F.replace("record", F.lit(","), F.lit(""))) + 1)
    reason = F.when(~F.col("closed"), UNCLOSED).when(F.col("n_cells") > width, TOO_MANY)
    records = records.withColumn("n_cells", cells.cast("int")).withColumn("reason", reason).drop("closed")
    return records, headers, spark.createDataFrame(list(paths.items()), "file long, path string")


def _rows(records: DataFrame, headers: list[list[str]], files: DataFrame, position: bool) -> DataFrame:
    """Cells of good records under their names; missing-value tokens as nulls."""
    widest = max(1, *map(len, headers))
    options = {"sep": ",", "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "maxColumns": str(widest + 1)}
    cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(widest)), options)
    names = list(dict.fromkeys(n for h in headers for n in h))
    # where each header has a column; null where it has none
    place = {n: F.array(*(F.lit(h.index(n) if n in h else None).cast("int") for h in headers)) for n in names}
    parsed = records.withColumn("cells", cells).withColumn("cells", F.array(*(F.col("cells")[f"c{i}"] for i in range(widest))))
    parsed = parsed.withColumn("cells", F.transform("cells", lambda c: F.when(~c.isin(NA_TOKENS), c)))
    columns = [F.get(F.col("cells"), F.element_at(place[n], F.col("header") + 1)).alias(n) for n in names]
    if position:
        parsed = parsed.join(F.broadcast(files), "file")  # a row per file: the driver holds them for the scan, too
        columns += [F.element_at(F.split("path", "/"), -1).alias(POSITION[0]), F.col("offset").alias(POSITION[1]),
                    F.col("line").alias(POSITION[2])]
    return parsed.select(*columns)


def _nothing(spark: SparkSession, schema: T.StructType | str | None) -> DataFrame:
    return spark.createDataFrame([], schema if schema is not None else T.StructType([]))


def scan_csv_large(spark: SparkSession, directory: str, schema: T.StructType | str | None = None, pattern: str = "*.csv",
                   position: bool = False) -> DataFrame:
    """The CSVs of ``directory`` stacked by column name (strings; missing
    columns null); a rejected record raises.  ``position`` adds the columns
    ``POSITION`` (file name, byte offset, line).  Without files, an empty table
    of ``schema``."""
    read = read_records(spark, directory, pattern)
    if read is None:
        return _nothing(spark, schema)
    records, headers, files = read
    said = F.concat(F.lit("a record of "), F.col("n_cells").cast("string"), F.lit(" cells at line "), F.col("line").cast("string"),
                    F.lit(": "), "reason", F.lit(": "), F.substring("record", 1, 200))
    good = F.when(F.col("reason").isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    return _rows(records.filter(good), headers, files, position)


def scan_csv_rejects(spark: SparkSession, directory: str, schema: T.StructType | str | None = None, pattern: str = "*.csv",
                     position: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of ``scan_csv_large`` without the rejected records, and these:
    (path, line, offset, n_cells, reason, record); ``line`` counts the file's
    lines from 1, ``offset`` its bytes from 0."""
    read = read_records(spark, directory, pattern)
    if read is None:
        return _nothing(spark, schema), _nothing(spark, "path string, line long, offset long, n_cells int, reason string, record string")
    records, headers, files = read
    rejects = records.filter("reason IS NOT NULL").join(F.broadcast(files), "file")
    return (_rows(records.filter("reason IS NULL"), headers, files, position),
            rejects.select("path", "line", "offset", "n_cells", "reason", "record"))


def write_raw_records(records: DataFrame, header: str, path: str) -> None:
    """Text files of records as they stand (a string column ``record``), each
    file under the header: for data that another program has already formatted."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = records.select(F.when(first, F.concat(F.lit(header + "\n"), F.col("record"))).otherwise(F.col("record")).alias("value"))
    lines.write.option("lineSep", "\n").text(path)
