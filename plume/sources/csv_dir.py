"""Read a directory of CSV files as one table, matching columns *by name*.

``spark.read.csv(dir)`` applies the first header to every file by
position, so files with another column order would land values in the wrong
columns.  Here:

1. the file list comes from Spark's own file index (``binaryFile`` source,
   ``path`` column only, so file contents are not read); a folder that is
   missing or holds no such file gives an empty table, any later failure is
   raised;
2. each file's first line comes from Spark's text source (any file system);
3. files are grouped by header; each group is read with an all-string
   schema in its header order, then the groups are stacked with
   ``unionByName(allowMissingColumns=True)``;
4. a record with more cells than its header raises, shorter records are
   filled with nulls, and pandas' missing-value tokens become null.

Quoted cells may hold newlines, so files are read with ``multiLine`` (one
task per file); pass ``multi_line=False`` for files without such cells, which
are then split.  ``csv_records`` splits files with such cells, too, and can
give rejected records as a table.
"""

from __future__ import annotations

import csv
import io

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import na_tokens_to_null

READ_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "mode": "PERMISSIVE"}
WRITE_OPTIONS = {"header": "true", "escape": '"', "quote": '"',
                 "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: One cell: quoted (what follows the closing quote up to the comma belongs to
#: it), unquoted, or empty; and a record's cells.  All quantifiers are
#: possessive, which keeps matching linear and free of recursion.
CELL = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
CELLS = rf"(?:\A|,){CELL}"
#: Tie-break of rows in reading order, if asked for.
POSITION = ["file_name", "file_offset", "file_row"]


def list_csv_files(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame | None:
    """Files directly inside ``directory`` matching ``pattern`` (not
    recursive); None if there is no such folder."""
    try:
        return (spark.read.format("binaryFile")
                .option("pathGlobFilter", pattern)
                .option("recursiveFileLookup", "false")
                .load(directory)
                .select("path"))
    except AnalysisException as exc:  # before any job
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _first_lines(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """(path, line): the first line of every file."""
    lines = (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").text(directory)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
             .filter("at = 0"))
    return (lines.withColumn("n", F.monotonically_increasing_id()).groupBy("path")
            .agg(F.min_by("value", "n").alias("line")))


def _columns(line: str) -> list[str]:
    """Column names of a header line."""
    line = line.lstrip("\ufeff").rstrip("\r")
    if line.count('"') % 2:
        raise ValueError(f"a header cell holds a line break: {line!r}")
    return next(csv.reader(io.StringIO(line)), [])


def scan_csv_dir(spark: SparkSession, directory: str, schema: T.StructType | str | None = None,
                 pattern: str = "*.csv", multi_line: bool = True, position: bool = False) -> DataFrame:
    """All CSVs of ``directory`` stacked by column name (strings; missing
    columns null).  An empty directory gives an empty table of ``schema``.
    ``position`` adds the columns ``POSITION``, which order rows as they
    stand in the files (file by file), for ties."""
    files = list_csv_files(spark, directory, pattern)
    # a row per distinct header with its files: metadata only
    groups = [] if files is None else (
        _first_lines(spark, directory, pattern).groupBy("line")
        .agg(F.sort_array(F.collect_list("path")).alias("paths")).collect())
    if not groups:
        if files is not None and not files.isEmpty() and schema is None:
            raise ValueError(f"the CSV files in {directory} have no header")
        return spark.createDataFrame([], schema if schema is not None else T.StructType([]))
    frames = []
    for g in sorted(groups, key=lambda r: r["line"]):
        names = _columns(g["line"])
        extra = "_other_width"
        while extra in names:
            extra += "_"
        # Spark puts a record of another width than the schema's here as it stands
        fields = [T.StructField(n, T.StringType(), True) for n in [*names, extra]]
        read = (spark.read.options(**READ_OPTIONS).option("multiLine", multi_line).option("columnPruning", "false")
                .option("columnNameOfCorruptRecord", extra)
                .schema(T.StructType(fields)).csv(g["paths"]))
        where = [F.col("_metadata.file_name").alias(POSITION[0]), F.col("_metadata.file_block_start").alias(POSITION[1]),
                 F.monotonically_increasing_id().alias(POSITION[2])]
        rows = read.select("*", *where) if position else read
        n_cells = F.regexp_count(F.regexp_replace(extra, r"[\r\n]+\z", ""), F.lit(CELLS))
        too_long = F.raise_error(F.concat(F.lit("a record has more cells than its header: "), F.col(extra))).cast("boolean")
        fits = F.when(F.col(extra).isNotNull() & (n_cells > len(names)), too_long).otherwise(F.lit(True))
        frames.append(rows.filter(fits).drop(extra))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return na_tokens_to_null(out)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """CSV with header, no index, UTF-8; null written as an empty cell."""
    df.write.mode(mode).options(**WRITE_OPTIONS).csv(path)


def roundtrip_enriched_csv(spark: SparkSession, enriched: DataFrame, read=scan_csv_dir) -> DataFrame:
    """Write the enriched table as two header groups (different column order,
    one extra column), read the directory back by name and clean it again."""
    from ..operators.cleaning import clean
    from ..session import scratch_path

    out = scratch_path(spark, "csvdir")
    cols_a = ["row_id", "textOriginal", "isProductRelated", "Predicted_Category", "predicted_sentiment",
              "likeCount_comment", "likeCount_video", "favouriteCount", "commentCount"]
    cols_b = ["commentCount", "predicted_sentiment", "likeCount_comment", "row_id", "textOriginal",
              "favouriteCount", "Predicted_Category", "likeCount_video", "isProductRelated"]
    prod = F.coalesce(F.col("isProductRelated") == "Product Related", F.lit(False))
    e = enriched.select(*[F.col(c).cast("string").alias(c) for c in cols_a])
    write_csv(e.filter(prod).select(*cols_a), out)
    write_csv(e.filter(~prod).select(*cols_b, F.lit("extra").alias("source_note")), out)
    back = read(spark, out)
    cleaned = clean(back.withColumn("row_id", F.col("row_id").cast("long")))
    return cleaned.select("row_id", "textOriginal", "isProductRelated", "Predicted_Category",
                          "predicted_sentiment", "likeCount_comment", "likeCount_video", "favouriteCount",
                          "commentCount", "comment_share_of_engagement")
