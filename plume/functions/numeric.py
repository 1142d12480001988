"""Numeric column expressions: coercion, guarded division, display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A plain decimal or scientific number with optional surrounding blanks.
# Spark's cast would also accept "1d" / "5f" (Java suffixes) that pandas
# rejects, so the text must match this first.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(inf|infinity)\s*$"


def coerce_number(col: Column | str, dtype: T.DataType | None = None) -> Column:
    """Number or 0: unparsable, null and NaN all become 0.0 (double)."""
    c = F.col(col) if isinstance(col, str) else col
    if dtype is not None and isinstance(dtype, T.NumericType):
        v = c.cast("double")
    else:
        s = c.cast("string")
        ok = s.rlike(NUMBER_PATTERN) | F.lower(s).rlike(INFINITY_PATTERN)
        v = F.when(ok, s.try_cast("double"))
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def ratio_nonzero(num: Column, den: Column) -> Column:
    """num / den, 0.0 where den == 0 (row SOE: any non-zero denominator)."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def ratio_positive(num: Column, den: Column) -> Column:
    """num / den, 0.0 unless den > 0 (aggregate SOE in the calculator)."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def percent(col: Column, decimals: int) -> Column:
    """Python ``{x:.N%}`` display: value x100 with N decimals and '%'.

    ``format_number`` rounds the double's exact value, ties to even, as Python
    does (``format_string`` rounds its shortest decimal form, ties up)."""
    return F.concat(F.replace(F.format_number(col * 100, decimals), F.lit(","), F.lit("")), F.lit("%"))


def thousands(col: Column) -> Column:
    """Python ``{n:,}`` display for integers."""
    return F.format_number(col, 0)


def round9(col: Column) -> Column:
    """For comparing doubles across engines (registered queries only)."""
    return F.round(col, 9)
