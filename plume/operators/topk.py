"""Most-liked lists.

``nlargest(5, likes)`` keeps the earlier row on ties; the row id is the
explicit tie-break.  One category: ``orderBy().limit()`` plans as
``TakeOrderedAndProject`` (per-task top 5, then a merge).  All categories
at once: ``row_number() <= 5`` plans as ``WindowGroupLimit`` Partial before
the shuffle and Final after it, so even a category with a third of all rows
ships at most 5 rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import TOP_K
from .aggregates import product_comments

CARD_COLUMNS = ["row_id", "Predicted_Category", "predicted_sentiment", "likeCount_comment", "textOriginal"]


def _order(likes: str = "likeCount_comment", tie: str = "row_id"):
    return [F.desc_nulls_last(likes), F.asc(tie)]


def top_liked(df: DataFrame, category: str, sentiment: str | None = None,
              k: int = TOP_K) -> DataFrame:
    """Top ``k`` most liked product-related comments of one category,
    optionally of one sentiment."""
    p = product_comments(df).filter(F.col("Predicted_Category") == category)
    if sentiment is not None:
        p = p.filter(F.col("predicted_sentiment") == sentiment)
    return p.orderBy(*_order()).limit(k).select(*CARD_COLUMNS)


def top_liked_all(df: DataFrame, sentiment: str | None = None, k: int = TOP_K) -> DataFrame:
    """Top ``k`` per category for every category in one job, with rank."""
    p = product_comments(df)
    if sentiment is not None:
        p = p.filter(F.col("predicted_sentiment") == sentiment)
    w = Window.partitionBy("Predicted_Category").orderBy(*_order())
    return (p.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select(*CARD_COLUMNS, F.col("rank").cast("long").alias("rank")))


def sort_rows(df: DataFrame, column: str, ascending: bool = True, tie: str = "row_id") -> DataFrame:
    """Explorer sort by any column; row id breaks ties (total order)."""
    key = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return df.orderBy(key, F.asc(tie))
