"""Composite plans: the dashboard's category overview (the flagship)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import NOT_APPLICABLE
from ..functions.numeric import coerce_number, ratio_positive
from ..operators import aggregates as A
from ..operators.cleaning import SOE_COLUMN, drop_missing_text, fill_labels
from ..sources import fixtures as FX
from ..sources.versions import SOURCE, VersionedTable


def category_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category of product-related comments: mean row SOE (the bar
    chart), engagement totals and aggregate SOE (the calculator's baseline).

    One ``groupBy`` computes all of it in a single pass over the enriched
    view (partial aggregation per task, one row per category shuffled).
    """
    e = FX.enriched(spark, sf_dir)
    agg = (A.product_comments(e).groupBy("Predicted_Category").agg(
        F.avg(SOE_COLUMN).alias("mean_soe"),
        F.sum("likeCount_comment").cast("long").alias("current_comment_likes"),
        F.sum("likeCount_video").cast("long").alias("current_video_likes"),
        F.sum("favouriteCount").cast("long").alias("current_video_favs"),
        F.sum("commentCount").cast("long").alias("current_video_comments")))
    den = F.col("current_video_likes") + F.col("current_video_favs") + F.col("current_video_comments")
    return (agg.filter(F.col("mean_soe").isNotNull())
            .withColumn("current_engagement", den)
            .withColumn("current_soe", ratio_positive(F.col("current_comment_likes").cast("double"),
                                                      den.cast("double")))
            .orderBy("Predicted_Category"))


def materialize_enriched(spark: SparkSession, sf_dir: str, path: str | None = None,
                         rows_per_file: int = 0) -> str:
    """Run the enrichment once and write the enriched table as Parquet in the
    shared folder (or ``path``); ``rows_per_file`` bounds the rows of a file
    (0: one file per task).

    This is the production shape of the dashboard: labelling reads every
    text once, and each tile afterwards reads only its own columns from
    Parquet (column pruning and predicate pushdown at the scan).  Returns
    the path; read it back with ``spark.read.parquet(path)``.
    """
    from ..session import scratch_path
    from ..sources.sinks import write_parquet_chunks

    out = path or scratch_path(spark, "enriched")
    write_parquet_chunks(FX.enriched(spark, sf_dir), out, rows_per_file)
    return out


def labelled_table(spark: SparkSession, path: str) -> VersionedTable:
    """The labelled comments as a versioned table: ``refresh`` labels the texts
    of new and changed files only, tiles read the columns they need."""
    def make(locations: list[str]) -> DataFrame:
        docs = spark.read.parquet(*locations).select("doc_id", "text", "source", "n_chars", F.col("_metadata.file_path").alias(SOURCE))
        c = drop_missing_text(FX.comments_from(docs, SOURCE))
        return fill_labels(FX.labelled(c)).select(
            "row_id", "videoId", "isProductRelated", "Predicted_Category",
            coerce_number(F.col("likeCount_comment")).alias("likeCount_comment"), SOURCE)

    return VersionedTable(spark, path, make)


def cached_volume(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Comments and likes per category of product-related comments, read from
    the versioned table below ``path`` after bringing it up to date."""
    from ..session import scratch_path

    table = labelled_table(spark, path or scratch_path(spark, "dashboard"))
    table.refresh(f"{sf_dir.rstrip('/')}/documents.parquet", "*.parquet")
    related = A.product_comments(table.read())
    return (related.filter(F.col("Predicted_Category") != NOT_APPLICABLE).groupBy("Predicted_Category")
            .agg(F.count(F.lit(1)).alias("comments"), F.sum("likeCount_comment").cast("long").alias("likes")))
