"""Continuous enrichment of arriving comments (stateless).

A file stream over the landing folder runs the same column expressions as
the batch view (comment derivation + relevance/category/brand record) and
appends to Parquet with a checkpoint, so a restarted or failed query picks
up exactly where it stopped.  ``availableNow`` processes what has landed
and stops (the batch-style trigger used by tests and the registry).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.labelling import analyze_comments
from ..session import scratch_path
from ..sources import fixtures as FX

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, landing_dir: str, max_files: int = 16,
                    schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """Documents as they land, as files or as folders of files
    (``documents*.parquet``); nothing need be there yet."""
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", max_files)
            .parquet(f"{landing_dir.rstrip('/')}/documents*.parquet"))


def enrich_stream(docs: DataFrame) -> DataFrame:
    return analyze_comments(FX.comments_from(docs))


def run_enrich_stream(spark: SparkSession, landing_dir: str, out: str | None = None) -> DataFrame:
    out = out or scratch_path(spark, "stream-enrich")
    records = enrich_stream(document_stream(spark, landing_dir))
    q = (records.writeStream
         .format("parquet")
         .option("path", out)
         .option("checkpointLocation", out + "_checkpoint")
         .outputMode("append")
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return spark.read.schema(records.schema).parquet(out)  # by its own schema: there may be no row yet
