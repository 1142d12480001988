"""Parquet table access.  Column lists are passed down so the scan's
``ReadSchema`` only holds what a query uses (Catalyst would prune anyway;
being explicit keeps wide text columns out of plans that do not need them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Fan a small scan out over all cores before CPU-heavy per-row work.

    A scan of few, large row groups (one per file here) yields fewer
    partitions than the cluster has cores, and the text labelling would run
    in that many tasks.  Then (and only then) the rows are hash-partitioned
    by ``key`` into ``defaultParallelism`` partitions.  At scale the scan
    already has far more splits than cores and this is a no-op, so the large
    input is never shuffled for it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)
