"""Dashboard and data-prep aggregates.

Every aggregate here is a hash aggregate with a partial (map-side) step, so a
category or sentiment that holds a third of all rows is reduced inside each
task before the shuffle; the shuffle carries one row per group per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import NOT_APPLICABLE, PRODUCT_RELATED, UNLABELED
from ..functions.text import tokens
from .cleaning import SOE_COLUMN


def product_comments(df: DataFrame) -> DataFrame:
    """Rows labelled 'Product Related' (null relevance is dropped)."""
    return df.filter(F.col("isProductRelated") == PRODUCT_RELATED)


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """pandas ``value_counts``: nulls excluded, count descending (ties by
    value; pandas uses first appearance there)."""
    return (df.filter(F.col(column).isNotNull())
            .groupBy(column).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.asc(column)))


def sentiment_overview(df: DataFrame) -> DataFrame:
    """Sentiment counts over all comments."""
    return value_counts(df, "predicted_sentiment")


def relevance_ratio(df: DataFrame) -> DataFrame:
    """Relevance counts; null relevance excluded."""
    return value_counts(df, "isProductRelated")


def category_volume(df: DataFrame) -> DataFrame:
    """Category counts of product-related rows, without '[Not Applicable]'."""
    p = product_comments(df).filter(F.col("Predicted_Category") != NOT_APPLICABLE)
    return value_counts(p, "Predicted_Category")


def sentiment_by_category(df: DataFrame) -> DataFrame:
    """Product-related counts per (category, sentiment); '[Not Applicable]'
    kept, zero cells absent."""
    return (product_comments(df)
            .groupBy("Predicted_Category", "predicted_sentiment")
            .agg(F.count(F.lit(1)).alias("count")))


def mean_soe_by_category(df: DataFrame) -> DataFrame:
    """Mean of row SOE per category over product-related rows, descending."""
    return (product_comments(df)
            .groupBy("Predicted_Category")
            .agg(F.avg(SOE_COLUMN).alias("mean_soe"))
            .na.drop(subset=["mean_soe"])
            .orderBy(F.desc("mean_soe"), F.asc("Predicted_Category")))


def category_totals(df: DataFrame) -> DataFrame:
    """Engagement totals per category (product-related), truncated to long.
    Video totals add a video once per comment, as the reference does."""
    return (product_comments(df)
            .groupBy("Predicted_Category")
            .agg(F.sum("likeCount_comment").cast("long").alias("current_comment_likes"),
                 F.sum("likeCount_video").cast("long").alias("current_video_likes"),
                 F.sum("favouriteCount").cast("long").alias("current_video_favs"),
                 F.sum("commentCount").cast("long").alias("current_video_comments")))


def category_options(df: DataFrame) -> DataFrame:
    """Sorted distinct categories of product-related rows, without the fill."""
    return (product_comments(df)
            .select("Predicted_Category").distinct()
            .filter(F.col("Predicted_Category") != NOT_APPLICABLE)
            .orderBy("Predicted_Category"))


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct values offered by the explorer's three filters, long form
    (filter_column, value); null kept as a selectable value.  One pass: each
    row is exploded into its three (column, value) pairs, then one distinct
    (partial aggregation per task) instead of three scans and a union."""
    cols = ("isProductRelated", "Predicted_Category", "predicted_sentiment")
    pairs = F.array(*[F.struct(F.lit(c).alias("filter_column"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    return df.select(F.inline(pairs)).distinct()


def weak_label_distribution(labelled: DataFrame, column: str = "category") -> DataFrame:
    return value_counts(labelled, column)


def weak_label_coverage(labelled: DataFrame, column: str = "category") -> DataFrame:
    """Rows before labelling, kept (labelled) and dropped (unlabeled), one pass."""
    return labelled.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(column) != UNLABELED).alias("labelled_rows"),
        F.count_if(F.col(column) == UNLABELED).alias("dropped_rows"))


def category_examples(labelled: DataFrame, text: str = "cleaned_text",
                      column: str = "category", order: str = "row_id") -> DataFrame:
    """First example (lowest row id) per labelled category."""
    return (labelled.filter(F.col(column) != UNLABELED)
            .groupBy(column)
            .agg(F.min_by(text, order).alias("example_text"),
                 F.min(order).alias("example_row_id")))


def top_terms(df: DataFrame, text: str = "textOriginal", k: int = 50) -> DataFrame:
    """Term frequency over whole texts (the word cloud's input): top ``k``
    by count, ties by term.  ``explode`` feeds a partial aggregate in the same
    stage, so per-task term counts are shuffled, never raw tokens."""
    terms = df.select(F.explode(tokens(F.col(text))).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("term")).limit(k)
