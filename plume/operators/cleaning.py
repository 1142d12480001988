"""Cleaning of the enriched comment table (the dashboard's data load).

All steps are narrow column expressions, so Catalyst folds ``clean`` into a
single projection right after the scan: no shuffle, no UDF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import NA_TOKENS, NOT_APPLICABLE, NUMERIC_COLUMNS, SENTIMENT_FILL
from ..functions.numeric import coerce_number, ratio_nonzero

SOE_COLUMN = "comment_share_of_engagement"


def na_tokens_to_null(df: DataFrame, columns: list[str] | None = None,
                      tokens: list[str] | None = None) -> DataFrame:
    """Map pandas' missing-value tokens in string columns to null."""
    tokens = NA_TOKENS if tokens is None else tokens
    string_cols = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    columns = [c for c in (columns or df.columns) if c in string_cols]
    return df.withColumns({
        c: F.when(F.col(c).isin(tokens), F.lit(None).cast("string")).otherwise(F.col(c))
        for c in columns
    }) if columns else df


def drop_missing_text(df: DataFrame, subset: tuple[str, ...] = ("textOriginal",)) -> DataFrame:
    """Drop rows whose key text is null (a cell of blanks is kept)."""
    return df.na.drop(subset=list(subset))


def fill_labels(df: DataFrame) -> DataFrame:
    """Null category -> '[Not Applicable]', null sentiment -> 'others'
    (for the label columns the table has)."""
    fills = {"Predicted_Category": NOT_APPLICABLE, "predicted_sentiment": SENTIMENT_FILL}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if c in df.columns})


def coerce_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Engagement columns to double; unparsable / null / NaN -> 0."""
    columns = [c for c in (columns or NUMERIC_COLUMNS) if c in df.columns]
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: coerce_number(F.col(c), types[c]) for c in columns}) if columns else df


def require_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add each missing engagement column as 0.0."""
    missing = [c for c in (columns or NUMERIC_COLUMNS) if c not in df.columns]
    return df.withColumns({c: F.lit(0.0) for c in missing}) if missing else df


def share_of_engagement(df: DataFrame) -> DataFrame:
    """Row SOE = comment likes / (video likes + favourites + comments),
    0 where that denominator is 0 (overwrites an existing column)."""
    den = F.col("likeCount_video") + F.col("favouriteCount") + F.col("commentCount")
    return df.withColumn(SOE_COLUMN, ratio_nonzero(F.col("likeCount_comment"), den))


def clean(df: DataFrame) -> DataFrame:
    """The dashboard's load-and-clean, in the reference's order."""
    df = drop_missing_text(df)
    df = fill_labels(df)
    df = coerce_counts(df)
    df = require_columns(df)
    return share_of_engagement(df)
