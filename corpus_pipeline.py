"""A training-data pipeline: documents in, a weighted mix of clean ones out.

Stages, each a function (spark, docs, sf_dir) -> DataFrame over all that its
predecessor kept, written as Parquet in the shared folder of
``spark.checkpoint.dir`` and read again as the next one's input (which goes
when the one after it is written):

1. ``quality``: documents that the quality classifier rejects go.
2. ``near_dedup``: of each group of SimHash near-duplicates one stays (3-word
   shingles, at most 3 differing bits; the smallest doc_id).
3. ``decontaminate``: benchmark passages are cut out of the texts.
4. ``personal_data``: personal data is replaced by its kind in brackets.
5. ``mixing``: sources are mixed to target weights; returns the documents that
   the mix takes with ``size``, ``source_size``, ``target``, ``taken`` and
   ``place`` beside the columns of documents.

The stages before the last return the columns of their input; where a text
changes, its ``n_chars`` (if there is such a column) follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plume.llm import decontaminate, mixing, pii, quality, simhash
from plume.session import scratch_path
from plume.sources.files import Folder


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, bits=3)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.mask(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", near_dedup),
    ("decontaminate", remove_benchmark),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: The classifier and the fingerprints are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # nothing reads the last stage's input any more
            Folder(spark, before).delete()
        before = path
    return docs
