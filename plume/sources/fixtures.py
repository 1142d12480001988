"""The comment view the whole library runs on, derived by Spark from the
given tables (``documents``, ``labels``).

``documents`` rows become comments, ``documents.source`` is the video.  The
invented test prose hits few beauty keywords, so (as laid down in
FIXTURES.md) keyword and brand words are appended to the text by fixed
arithmetic on ``doc_id``.  That arithmetic only decides *which words are
appended*; no row is filtered or sampled by it and no text is cut, so the view
keeps every document and grows with the table.  Only ``comments_with_gaps``,
the input of the key that drops missing texts, has null texts.

The labels and derived columns are computed with the native expressions of
``plume.functions.labels``; the SQL oracle computes the same view with an
independent join form (lexicon x comments on ``contains``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import (BRANDS, NOT_PRODUCT_RELATED, PRODUCT_RELATED,
                                      lexicon_rows)
from ..functions.fixed_values import UNLABELED
from ..functions.labels import sql_array
from .tables import read_table, spread

# Fixture parameters (FIXTURES.md part 3): which documents get a keyword,
# a brand, a null text, an unparsable like count, a null relevance.
KEYWORD_EVERY, BRAND_EVERY, NULL_TEXT_MOD, NULL_TEXT_AT = 5, 7, 40, 7
BAD_LIKES_EVERY, NULL_RELEVANCE_MOD, NULL_RELEVANCE_AT = 17, 53, 5
ZERO_ENGAGEMENT_EVERY = 7


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, videoId, textOriginal, likeCount_comment (text, like a CSV cell)."""
    def build():
        docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source", "n_chars"])
        return comments_from(spread(docs, "doc_id"))
    return _memo("comments", spark, sf_dir, build)


def comments_from(d: DataFrame, *carry: str) -> DataFrame:
    """The comment derivation over a documents frame (batch or stream);
    ``carry`` names columns that ride along."""
    keywords = sql_array([r[3] for r in lexicon_rows()])
    kw = F.expr(f"element_at({keywords}, CAST(pmod(doc_id, {len(lexicon_rows())}) + 1 AS INT))")
    brand = F.expr(f"element_at({sql_array(BRANDS)}, CAST(pmod(doc_id, {len(BRANDS)}) + 1 AS INT))")
    text = F.concat(
        F.col("text"),
        F.when(F.col("doc_id") % KEYWORD_EVERY != 0, F.concat(F.lit(" "), kw)).otherwise(F.lit("")),
        F.when(F.col("doc_id") % BRAND_EVERY == 0, F.concat(F.lit(" "), F.upper(brand))).otherwise(F.lit("")),
    )
    return d.select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("videoId"),
        text.alias("textOriginal"),
        F.when(F.col("doc_id") % BAD_LIKES_EVERY == 0, F.lit("bad"))
        .otherwise((F.col("n_chars") % 50).cast("string")).alias("likeCount_comment"),
        *carry,
    )


def comments_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments with a missing text in one of ``NULL_TEXT_MOD``."""
    gap = F.col("row_id") % NULL_TEXT_MOD == NULL_TEXT_AT
    return comments(spark, sf_dir).withColumn("textOriginal", F.when(~gap, F.col("textOriginal")))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per video (source) with its engagement; an aggregate of
    ``documents`` read through the ``source`` column only."""
    return _memo("videos", spark, sf_dir, lambda: _videos(spark, sf_dir))


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_source = (read_table(spark, sf_dir, "documents", ["source"])
                  .groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    v = F.substring(F.col("source"), 4, 1 << 20).cast("int")
    zero = (v % ZERO_ENGAGEMENT_EVERY == 0)
    return per_source.select(
        F.col("source").alias("videoId"),
        F.when(zero, F.lit(0)).otherwise(v * 1000).cast("bigint").alias("likeCount_video"),
        F.when(zero, F.lit(0)).otherwise(v * 10).cast("bigint").alias("favouriteCount"),
        F.when(zero, F.lit(0)).otherwise(F.col("n")).cast("bigint").alias("commentCount"),
    )


def sentiment_from_labels(labels: DataFrame) -> DataFrame:
    """doc_id -> predicted sentiment (toxic -> negative, quality 1/0 ->
    positive/neutral)."""
    return labels.select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("toxic") == 1, F.lit("negative"))
        .when(F.col("quality") == 1, F.lit("positive"))
        .when(F.col("quality") == 0, F.lit("neutral")).alias("predicted_sentiment"),
    )


_VIEWS: dict[tuple[str, str, str], DataFrame] = {}


def _memo(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """Build a view's (lazy) plan once per application and data folder.

    Only the DataFrame object is kept - no data is cached - so every query
    still scans and computes from the tables; what is saved is the Python
    side plan construction.  Call ``forget_views()`` after the files change.
    """
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    df = _VIEWS.get(key)
    if df is None:
        df = _VIEWS[key] = build()
    return df


def forget_views() -> None:
    _VIEWS.clear()


def raw_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched comment table as the batch pipeline would export it,
    before the dashboard's cleaning: labels may be null, counts are text or
    null.  Columns: row_id, videoId, textOriginal, likeCount_comment,
    likeCount_video, favouriteCount, commentCount, isProductRelated,
    Predicted_Category, predicted_sentiment."""
    return _memo("raw_enriched", spark, sf_dir, lambda: _raw_enriched(spark, sf_dir))


def labelled(c: DataFrame) -> DataFrame:
    """Comments with their category (null if none) and relevance."""
    from ..operators.labelling import weak_labels

    c = weak_labels(c, "textOriginal", "_label")
    c = c.withColumn("Predicted_Category",
                     F.when(F.col("_label") != UNLABELED, F.col("_label"))).drop("_label")
    return c.withColumn("isProductRelated", relevance(F.col("Predicted_Category").isNotNull()))


def relevance(has_category: Column) -> Column:
    """The relevance of a comment that has a category or not (some are null)."""
    return (F.when(F.col("row_id") % NULL_RELEVANCE_MOD == NULL_RELEVANCE_AT, F.lit(None).cast("string"))
            .when(~has_category, F.lit(NOT_PRODUCT_RELATED))
            .otherwise(F.lit(PRODUCT_RELATED)))


def _raw_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import integrate_videos

    c = labelled(comments(spark, sf_dir))
    joined = integrate_videos(c, videos(spark, sf_dir))
    sent = sentiment_from_labels(read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]))
    return joined.join(sent, "row_id", "left")


def raw_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported table without the category/relevance labels (comments,
    video engagement, sentiment): for queries that never read the labels,
    so no labelling pass runs for them."""
    def build():
        from ..operators.joins import integrate_videos
        joined = integrate_videos(comments(spark, sf_dir), videos(spark, sf_dir))
        sent = sentiment_from_labels(read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]))
        return joined.join(sent, "row_id", "left")
    return _memo("raw_base", spark, sf_dir, build)


def enriched_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``enriched`` without the label columns (same rows, same values)."""
    from ..operators.cleaning import clean

    return _memo("enriched_base", spark, sf_dir, lambda: clean(raw_base(spark, sf_dir)))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned comment table with row SOE (the dashboard's input)."""
    from ..operators.cleaning import clean

    return _memo("enriched", spark, sf_dir, lambda: clean(raw_enriched(spark, sf_dir)))
