"""Text column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters kept by ``normalize_text``; a wider class (e.g. "a-z0-9à-ÿ") can
# be passed for accented input.
ASCII_WORD_CLASS = "a-z0-9"


def normalize_text(col: Column | str, keep: str = ASCII_WORD_CLASS) -> Column:
    """Lowercase, turn every run of other characters into one space, trim.

    Our rule for the prose-only "token cleaning, lowercasing, removing
    special characters" step.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(c), f"[^{keep}]+", " "))


def tokens(col: Column | str, keep: str = ASCII_WORD_CLASS) -> Column:
    """Whitespace tokens of the normalized text; empty text -> empty array."""
    norm = normalize_text(col, keep)
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def is_blank(col: Column | str) -> Column:
    """Null, empty or white space of any kind only."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def title_case(col: Column | str) -> Column:
    """Display form of a label (``initcap``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.initcap(c)
