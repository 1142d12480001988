"""Comment enrichment: relevance -> (category, sentiment, brands), gated.

With the lexicon scorers the gate is a condition on the columns of one
projection: all stages read the same match array, so the whole pipeline is one
narrow pass per input partition, and only ids and labels meet the sentiment.
(Costly scorers are gated by filtering first, see ``ml.gated_ml``.)  Every
input row gives one output row; blank texts are kept unclassified.

Staging: ``lower(text)`` -> ``matches`` (one regex pass over the text for
all terms, behind a one-row generator so the optimizer cannot copy it) ->
score array; every label, score, brand list and relevance flag reads those
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import CATEGORY_KEYWORDS
from ..functions.text import is_blank
from ..functions.labels import (brand_list, category_found, keyword_relevant, label_of,
                                loose_matches, normalized_matches, relevance_terms, score_of,
                                score_structs, term_matches, winner_share_of)

LOWER = "_text_lower"
MATCHES = "_matches"
SCORES = "_scores"
_WORK = [LOWER, MATCHES, SCORES]


def with_matches(df: DataFrame, text: str, extra_terms: list[str] | None = None) -> DataFrame:
    """Add the distinct lexicon/brand/extra terms contained in the text.

    The match array is produced by a one-row generator (``inline`` of a
    one-element array).  Filters on anything derived from it (category,
    relevance, ...) cannot be pushed below a generator's output, so the
    regex pass runs exactly once per row.  As a plain projection, filter
    pushdown and constraint inference copy the expression into every pushed
    filter (up to 46 copies were seen in one plan).
    """
    d = df.withColumn(LOWER, F.lower(F.col(text)))
    matches = term_matches(LOWER, relevance_terms(extra_terms))
    return d.select("*", F.inline(F.array(F.struct(matches.alias(MATCHES))))).drop(LOWER)


def with_scores(df: DataFrame, text: str) -> DataFrame:
    return with_matches(df, text).withColumn(SCORES, score_structs(MATCHES))


def _drop_work(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in _WORK if c in df.columns])


def weak_labels(df: DataFrame, text: str = "cleaned_text", out: str = "category") -> DataFrame:
    """Add the keyword-count category ('unlabeled' when nothing hits)."""
    return _drop_work(with_scores(df, text).withColumn(out, label_of(SCORES)))


def weak_labels_both(df: DataFrame, text: str, found: str = "found", out: str = "category") -> DataFrame:
    """Of one scan of ``text``: ``found``, whether it has a category as it is
    (null text: none), and ``out``, the category of its normalized form (as
    ``weak_labels`` of ``normalize_text``)."""
    terms = [w for words in CATEGORY_KEYWORDS.values() for w in words]
    passages = loose_matches(LOWER, terms)
    d = df.withColumn(LOWER, F.lower(F.col(text)))
    d = d.select("*", F.inline(F.array(F.struct(passages.alias(MATCHES))))).withColumn(found, category_found(MATCHES))
    d = d.withColumn(MATCHES, normalized_matches(MATCHES)).withColumn(SCORES, score_structs(MATCHES))
    return _drop_work(d.withColumn(out, label_of(SCORES)))


def category_score_columns(df: DataFrame, text: str = "textOriginal") -> DataFrame:
    """One column per category: number of distinct keywords contained."""
    d = with_scores(df, text)
    return _drop_work(d.withColumns({f"score_{c}": score_of(SCORES, i).cast("long")
                                     for i, c in enumerate(CATEGORY_KEYWORDS)}))


def brand_columns(df: DataFrame, text: str = "textOriginal") -> DataFrame:
    """Brands mentioned (array, list order) and their ', '-joined tags."""
    d = with_matches(df, text).withColumn("brand_list", brand_list(MATCHES))
    return _drop_work(d.withColumn("brands", F.array_join("brand_list", ", ")))


def keyword_relevance(df: DataFrame, text: str = "textOriginal", out: str = "is_related",
                      extra_terms: list[str] | None = None) -> DataFrame:
    d = with_matches(df, text, extra_terms)
    return _drop_work(d.withColumn(out, keyword_relevant(MATCHES)))


def confidence(df: DataFrame, text: str = "textOriginal") -> DataFrame:
    """Lexicon category and its confidence (winner's share of all hits)."""
    d = with_scores(df, text)
    return _drop_work(d.withColumns({"category": label_of(SCORES),
                                     "confidence": winner_share_of(SCORES)}))


def gated_pipeline(df: DataFrame, sentiment: DataFrame | None = None,
                   text: str = "textOriginal", key: str = "row_id") -> DataFrame:
    """Relevance first; only related rows get a category and a sentiment.

    ``sentiment``: optional (key, predicted_sentiment) scorer output, joined
    to the related rows only.  Output: key, is_related, category, sentiment.
    """
    # blank input is kept but not classified: is_related is null
    d = with_scores(df.select(key, text), text)
    related = F.when(~is_blank(text), keyword_relevant(MATCHES))
    done = d.select(key, related.alias("is_related"), F.when(related, label_of(SCORES)).alias("category"))
    if sentiment is None:
        return done.withColumn("sentiment", F.lit(None).cast("string"))
    # the text is gone before the join
    known = sentiment.select(key, F.col("predicted_sentiment").alias("sentiment"))
    return done.join(known, key, "left").withColumn("sentiment", F.when(F.col("is_related"), F.col("sentiment")))


def analyze_comments(df: DataFrame, text: str = "textOriginal", key: str = "row_id") -> DataFrame:
    """End-to-end record per comment: is_related Yes/No ('N/A' for blank
    text), category or 'N/A', brands joined or 'N/A', relevance_score (null
    for blank text), category_score (null when unrelated).  Lexicon scorers: relevance_score is 1.0 (a rule is certain),
    category_score is the winner's share of keyword hits."""
    d = with_scores(df.select(key, text), text)
    d = d.withColumn("_rel", F.when(~is_blank(text), keyword_relevant(MATCHES)))
    rel = F.col("_rel")
    return d.select(
        key,
        F.col(text).alias("comment"),
        F.when(rel, F.lit("Yes")).when(~rel, F.lit("No")).otherwise(F.lit("N/A")).alias("is_related"),
        F.when(rel, label_of(SCORES)).otherwise(F.lit("N/A")).alias("category"),
        F.when(rel, F.array_join(brand_list(MATCHES), ", ")).otherwise(F.lit("N/A")).alias("brands"),
        F.when(rel.isNotNull(), F.lit(1.0)).alias("relevance_score"),
        F.when(rel, winner_share_of(SCORES)).alias("category_score"),
    )


def keyword_hits(df: DataFrame, text: str = "textOriginal", key: str = "row_id") -> DataFrame:
    """Audit form of the keyword test: one row per (comment, category) with
    the number of distinct keywords hit, only where it is > 0."""
    d = with_scores(df.select(key, text), text)
    return (d.select(key, F.posexplode(SCORES).alias("cat_rank", "p"))
            .select(key, F.col("p.c").alias("category"), F.col("cat_rank").cast("long").alias("cat_rank"),
                    F.col("p.s").cast("long").alias("score"))
            .filter(F.col("score") > 0))
