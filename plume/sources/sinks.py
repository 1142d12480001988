"""Sinks: CSV export of a filtered view, Parquet in bounded file sizes.

Exports are written as a directory of part files by the executors in
parallel; nothing is funnelled through the driver or a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path
from .csv_dir import scan_csv_dir, write_csv

ROWS_PER_FILE = 10_000
EXPORT_COLUMNS = ["row_id", "textOriginal", "isProductRelated", "Predicted_Category",
                  "predicted_sentiment", "likeCount_comment"]


def write_parquet_chunks(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE,
                         mode: str = "overwrite") -> None:
    """Parquet with at most ``rows_per_file`` rows per file."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_parquet_exact(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "overwrite") -> None:
    """Parquet files of exactly ``rows_per_file`` rows each; only one holds the
    remainder.

    The rows are written once to the shared checkpoint folder, which fixes their
    places.  A row's global place is the rows of the partitions before (one
    number per partition passes the driver) plus its place in its own; whole
    files' worth of places are then dealt to tasks, and each task cuts them at
    that size.  No task sees more than the files dealt to it."""
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.checkpoint(eager=True)
    at, part, before, chunk = (free_name(df, c) for c in ("at", "part", "before", "chunk"))
    placed = placed.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33))
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, done = [], 0
    for r in sorted(sizes, key=lambda r: r[part]):
        starts.append((r[part], done))
        done += r.n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, f"`{part}` long, `{before}` long"))  # a row per partition
    place = F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    (placed.join(offsets, part).withColumn(chunk, F.floor(place / rows_per_file))
     .repartition(chunk).sortWithinPartitions(chunk, at)  # the remainder has the largest number: last in its task
     .select(*(F.col(f"`{c}`") for c in df.columns))
     .write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first free variant of it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parquet_roundtrip(spark: SparkSession, df: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    out = scratch_path(spark, "parquet")
    write_parquet_chunks(df, out, rows_per_file)
    return spark.read.parquet(out)


def file_row_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows per written file (checks the file-size bound)."""
    return (spark.read.parquet(path).groupBy(F.input_file_name().alias("file"))
            .agg(F.count(F.lit(1)).alias("rows")))


def export_filtered(spark: SparkSession, enriched: DataFrame, mask: Column,
                    path: str | None = None) -> DataFrame:
    """Write the explorer's filtered rows as CSV, read the export back."""
    out = path or scratch_path(spark, "export")
    view = enriched.filter(mask).select(*EXPORT_COLUMNS)
    write_csv(view.select(*[F.col(c).cast("string").alias(c) for c in EXPORT_COLUMNS]), out, mode="overwrite")
    back = scan_csv_dir(spark, out)
    return back.select(F.col("row_id").cast("long").alias("row_id"), "textOriginal", "isProductRelated",
                       "Predicted_Category", "predicted_sentiment",
                       F.col("likeCount_comment").cast("double").alias("likeCount_comment"))
