"""Data explorer: multi-select filters, search, counts, export."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def isin_with_null(col: Column | str, values: Iterable) -> Column:
    """pandas ``isin``: a listed None also matches null.  Empty list -> false."""
    c = F.col(col) if isinstance(col, str) else col
    values = list(values)
    concrete = [v for v in values if v is not None]
    cond = c.isin(concrete) if concrete else F.lit(False)
    if any(v is None for v in values):
        cond = cond | c.isNull()
    return F.coalesce(cond, F.lit(False))


def explorer_mask(relevance: Iterable, categories: Iterable, sentiments: Iterable) -> Column:
    return (isin_with_null("isProductRelated", relevance)
            & isin_with_null("Predicted_Category", categories)
            & isin_with_null("predicted_sentiment", sentiments))


def explorer_counts(df: DataFrame, mask: Column) -> DataFrame:
    """'Displaying n of N rows' in one pass."""
    return df.agg(F.count_if(mask).alias("shown_rows"), F.count(F.lit(1)).alias("total_rows"))


def explorer_search(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Case-insensitive substring search over string columns (any matches)."""
    string_cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    columns = [c for c in (columns or string_cols) if c in string_cols]
    needle = term.lower()
    cond = None
    for c in columns:
        hit = F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
        cond = hit if cond is None else (cond | hit)
    return df.filter(cond if cond is not None else F.lit(False))
