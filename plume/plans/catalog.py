"""Registered queries: one callable (spark, sf_dir) -> DataFrame per
operator of the inventory.  Each reads the given tables (through the comment
view of ``sources.fixtures``), so its work grows with them.

Column names match ``oracle.oracle_sql()`` key by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import NOT_APPLICABLE, PRODUCT_RELATED
from ..functions.numeric import round9
from ..functions.text import normalize_text, title_case
from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import explorer as X
from ..operators import labelling as L
from ..operators import metrics as M
from ..operators import soe as S
from ..operators import topk as K
from ..operators import training as T
from ..operators.joins import integrate_raw, integrate_videos
from ..sources import fixtures as FX
from ..sources.tables import read_table
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]

CARD = ["row_id", "Predicted_Category", "predicted_sentiment", "likeCount_comment", "textOriginal"]


def _e(spark: SparkSession, sf: str) -> DataFrame:
    return FX.enriched(spark, sf)


def _src(spark: SparkSession, sf: str) -> DataFrame:
    return T.training_source(_e(spark, sf))


def _s2(spark: SparkSession, sf: str) -> DataFrame:
    return T.stage2_labelled(_src(spark, sf))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, textOriginal) of the comments that survive cleaning - the
    same rows as the enriched view, for text-only operators that need no
    labels (so no labelling pass runs for them)."""
    return C.drop_missing_text(FX.comments(spark, sf)).select("row_id", "textOriginal")


def _s2labelled(spark: SparkSession, sf: str) -> DataFrame:
    # read twice (label-id table and the join): written once to the shared
    # checkpoint folder instead of labelling twice
    return _s2(spark, sf).checkpoint(eager=True)


def _s2enc(spark: SparkSession, sf: str) -> DataFrame:
    lab = _s2labelled(spark, sf)
    ids = T.label_ids(lab)
    return T.label_encode(lab, ids).select("row_id", F.col("cleaned_text").alias("text"), "category", "label")


def _s2split(spark: SparkSession, sf: str) -> DataFrame:
    # built on the checkpointed labelled set: the split's passes and its
    # final join do not recompute the labels
    return T.stratified_split(_s2enc(spark, sf), "label")


def _explorer_mask():
    return X.explorer_mask(O.EXPLORER_RELEVANCE, O.EXPLORER_CATEGORIES, O.EXPLORER_SENTIMENTS)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to 9 decimals, for the comparison with the oracle only."""
    return df.withColumns({c: round9(F.col(c)) for c in columns})


# --- sources / joins ---------------------------------------------------------

def q_integrate_videos(spark, sf):
    c = FX.comments(spark, sf)
    return integrate_videos(c, FX.videos(spark, sf)).select(
        "row_id", "videoId", "likeCount_video", "favouriteCount", "commentCount")


def q_integrate_raw(spark, sf):
    """Raw comments and raw videos, which both call their likes ``likeCount``."""
    c = FX.comments(spark, sf).withColumnRenamed("likeCount_comment", "likeCount")
    return integrate_raw(c, FX.videos(spark, sf).withColumnRenamed("likeCount_video", "likeCount")).drop("textOriginal")


def q_scan_csv_dir(spark, sf):
    from ..sources.csv_dir import roundtrip_enriched_csv
    return roundtrip_enriched_csv(spark, _e(spark, sf))


def q_scan_csv_large(spark, sf):
    """The files of ``scan_csv_dir``, each read by as many tasks as it has byte ranges."""
    from ..sources.csv_dir import roundtrip_enriched_csv
    from ..sources.csv_records import scan_csv_large
    return roundtrip_enriched_csv(spark, _e(spark, sf), scan_csv_large)


def q_scan_csv_rejects(spark, sf):
    """An export that forgets the quotes of cells with nothing but commas in
    them: the rows that can be read, and the rejected records with their cells."""
    from ..session import scratch_path
    from ..sources.csv_records import scan_csv_rejects, write_raw_records
    text, path = F.col("textOriginal"), scratch_path(spark, "careless")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    record = F.concat_ws(",", "row_id", F.when(text.rlike('["\\r\\n]'), quoted).otherwise(text))
    write_raw_records(_texts(spark, sf).select(record.alias("record")), "row_id,textOriginal", path)
    rows, rejects = scan_csv_rejects(spark, path, pattern="*.txt")
    none = F.lit(None)
    return rows.select(F.col("row_id").cast("long").alias("row_id"), "textOriginal",
                       none.cast("int").alias("n_cells"), none.cast("string").alias("reason")).unionByName(
        rejects.select(F.regexp_extract("record", "^([0-9]+),", 1).cast("long").alias("row_id"),
                       none.cast("string").alias("textOriginal"), "n_cells", "reason"))


def q_export_filtered(spark, sf):
    from ..sources.sinks import export_filtered
    return export_filtered(spark, _e(spark, sf), _explorer_mask())


def q_parquet_chunks(spark, sf):
    from ..sources.sinks import parquet_roundtrip
    return parquet_roundtrip(spark, _e(spark, sf)).select(
        "row_id", "isProductRelated", "Predicted_Category", "predicted_sentiment", "comment_share_of_engagement")


def q_parquet_file_bound(spark, sf):
    """Files of at most 100 rows: whether all keep the bound, rows in all."""
    from ..session import scratch_path
    from ..sources.sinks import file_row_counts, write_parquet_chunks
    out = scratch_path(spark, "bounded")
    write_parquet_chunks(_e(spark, sf).select("row_id", "Predicted_Category"), out, rows_per_file=100)
    files = file_row_counts(spark, out)
    return files.agg((F.max("rows") <= 100).alias("within_bound"), F.sum("rows").alias("rows"))


def q_parquet_exact_chunks(spark, sf):
    """Files of exactly 100 rows: how many files have how many rows."""
    from ..session import scratch_path
    from ..sources.sinks import file_row_counts, write_parquet_exact
    out = scratch_path(spark, "exact")
    write_parquet_exact(_e(spark, sf).select("row_id", "Predicted_Category"), out, rows_per_file=100)
    return file_row_counts(spark, out).groupBy("rows").agg(F.count(F.lit(1)).alias("files"))


def q_union_by_name(spark, sf):
    e = _e(spark, sf)
    prod = e.filter(F.col("isProductRelated") == PRODUCT_RELATED)
    other = e.filter(~F.coalesce(F.col("isProductRelated") == PRODUCT_RELATED, F.lit(False)))
    a = prod.select("row_id", "Predicted_Category", "likeCount_comment")
    b = other.select("row_id", "predicted_sentiment", "likeCount_comment", "isProductRelated")
    return a.unionByName(b, allowMissingColumns=True)


# --- cleaning ----------------------------------------------------------------

def q_drop_missing_text(spark, sf):
    return C.drop_missing_text(FX.comments_with_gaps(spark, sf)).select("row_id", "textOriginal")


def q_fill_labels(spark, sf):
    raw = C.drop_missing_text(FX.raw_enriched(spark, sf))
    return C.fill_labels(raw).select("row_id", "Predicted_Category", "predicted_sentiment")


def q_coerce_counts(spark, sf):
    raw = C.drop_missing_text(FX.raw_base(spark, sf))
    return C.coerce_counts(raw).select("row_id", "likeCount_comment", "likeCount_video",
                                       "favouriteCount", "commentCount")


def q_require_columns(spark, sf):
    c = C.drop_missing_text(FX.comments(spark, sf))
    return C.require_columns(C.coerce_counts(c)).select(
        "row_id", "likeCount_comment", "likeCount_video", "favouriteCount", "commentCount")


def q_share_of_engagement(spark, sf):
    return FX.enriched_base(spark, sf).select("row_id", C.SOE_COLUMN)


def q_normalize_text(spark, sf):
    return _texts(spark, sf).select("row_id", normalize_text("textOriginal").alias("cleaned_text"))


def q_keyword_hits_large(spark, sf):
    """The comments against every phrase of one to six words of the benchmark."""
    from ..operators.lexicon import lexicon_hits, lexicon_terms
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))
    phrases = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))))
    lexicon = (read_table(spark, sf, "benchmark", ["text"]).select(words.alias("w")).filter(F.size("w") > 0)
               .select(F.explode(phrases).alias("term")))
    found = lexicon_hits(_texts(spark, sf), lexicon_terms(lexicon))
    return found.select("row_id", F.size("hits").cast("long").alias("n_hits"), F.md5(F.array_join("hits", ",")).alias("hits_md5"))


def q_keyword_hits(spark, sf):
    return L.keyword_hits(FX.comments(spark, sf).na.drop(subset=["textOriginal"]))


def q_brand_tags(spark, sf):
    return L.brand_columns(_texts(spark, sf)).select("row_id", "brands")


def q_display_labels(spark, sf):
    p = A.product_comments(_e(spark, sf)).filter(F.col("Predicted_Category") != NOT_APPLICABLE)
    return p.select("row_id", title_case("Predicted_Category").alias("category_display"),
                    title_case("predicted_sentiment").alias("sentiment_display"))


def q_soe_display(spark, sf):
    return S.baseline_display(S.category_soe(_e(spark, sf)))


def q_scenario_display(spark, sf):
    e = _e(spark, sf)
    return S.soe_display(S.soe_scenarios(e, S.derived_scenarios(e)).filter("valid"))


def q_label_ids(spark, sf):
    return T.label_ids(_s2(spark, sf))


def q_label_encode(spark, sf):
    return _s2enc(spark, sf).select("row_id", "text", "label")


def q_label_decode(spark, sf):
    lab = _s2labelled(spark, sf)
    ids = T.label_ids(lab)
    enc = T.label_encode(lab, ids).select(
        "row_id", F.concat(F.lit("LABEL_"), F.col("label").cast("string")).alias("model_label"))
    return T.label_decode(enc, ids, "model_label", "decoded")


def q_train_columns(spark, sf):
    return T.train_columns(_src(spark, sf))


# --- filters -----------------------------------------------------------------

def q_product_comments(spark, sf):
    return A.product_comments(_e(spark, sf)).select(*CARD)


def q_explorer_filter(spark, sf):
    return _e(spark, sf).filter(_explorer_mask()).select(
        "row_id", "isProductRelated", "Predicted_Category", "predicted_sentiment", "likeCount_comment")


def q_explorer_search(spark, sf):
    return X.explorer_search(_e(spark, sf), O.SEARCH_TERM).select(
        "row_id", "Predicted_Category", "predicted_sentiment")


def q_explorer_search_indexed(spark, sf):
    """``explorer_search`` through an index of character triples."""
    from ..operators.search_index import SearchIndex
    from ..session import scratch_path
    index = SearchIndex(spark, scratch_path(spark, "search"))
    index.build(_e(spark, sf))
    return index.search(O.SEARCH_TERM).select("row_id", "Predicted_Category", "predicted_sentiment")


def q_spam_filter(spark, sf):
    return T.spam_flags(_texts(spark, sf))


def q_spam_removed(spark, sf):
    return T.remove_spam(_texts(spark, sf))


# --- aggregates --------------------------------------------------------------

def q_sentiment_overview(spark, sf):
    return A.sentiment_overview(FX.enriched_base(spark, sf))


def q_relevance_ratio(spark, sf):
    return A.relevance_ratio(_e(spark, sf))


def q_category_volume(spark, sf):
    return A.category_volume(_e(spark, sf))


def q_sentiment_by_category(spark, sf):
    return A.sentiment_by_category(_e(spark, sf))


def q_mean_soe_by_category(spark, sf):
    return _rounded(A.mean_soe_by_category(_e(spark, sf)), "mean_soe")


def q_category_totals(spark, sf):
    return A.category_totals(_e(spark, sf))


def q_category_options(spark, sf):
    return A.category_options(_e(spark, sf))


def q_filter_options(spark, sf):
    return A.filter_options(_e(spark, sf))


def q_explorer_counts(spark, sf):
    return X.explorer_counts(_e(spark, sf), _explorer_mask())


def q_weak_labels(spark, sf):
    return _s2(spark, sf).filter(F.col("category") != "unlabeled").select("row_id", "category")


def q_weak_label_distribution(spark, sf):
    return A.weak_label_distribution(_s2(spark, sf))


def q_weak_label_coverage(spark, sf):
    return A.weak_label_coverage(_s2(spark, sf))


def q_category_examples(spark, sf):
    return A.category_examples(_s2(spark, sf))


def q_category_scores(spark, sf):
    return L.category_score_columns(_texts(spark, sf)).select(
        "row_id", *[f"score_{c}" for c in O.CATS])


def q_top_terms(spark, sf):
    return A.top_terms(_texts(spark, sf), k=50)


# --- top-k -------------------------------------------------------------------

def q_top_liked_one(spark, sf):
    return K.top_liked(_e(spark, sf), "skincare")


def q_top_positive(spark, sf):
    return K.top_liked(_e(spark, sf), "skincare", "positive")


def q_top_negative(spark, sf):
    return K.top_liked(_e(spark, sf), "makeup", "negative")


def q_top_liked_all(spark, sf):
    return K.top_liked_all(_e(spark, sf))


def q_explorer_sort(spark, sf):
    return K.sort_rows(_e(spark, sf).select("row_id", "likeCount_comment", "Predicted_Category"),
                       "likeCount_comment", ascending=False)


# --- labelling ---------------------------------------------------------------

def q_keyword_relevance(spark, sf):
    return L.keyword_relevance(_texts(spark, sf)).select("row_id", "is_related")


def q_gated_pipeline(spark, sf):
    sent = FX.sentiment_from_labels(read_table(spark, sf, "labels", ["doc_id", "quality", "toxic"]))
    return L.gated_pipeline(_texts(spark, sf), sentiment=sent)


def q_analyze_comments(spark, sf):
    return L.analyze_comments(_texts(spark, sf))


def q_confidence(spark, sf):
    return L.confidence(_texts(spark, sf)).select("row_id", "category", "confidence")


def q_argmax_label(spark, sf):
    from ..functions.labels import argmax_index
    emb = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    return emb.select("vec_id", "label", argmax_index(F.col("embedding")).alias("predicted"))


# --- training data -----------------------------------------------------------

def q_balance_classes(spark, sf):
    # the classes alone, written once: the passes of the selection label no text again
    labels = _src(spark, sf).select("row_id", "isProductRelated").checkpoint(eager=True)
    return T.balance_classes(labels).select("row_id", "isProductRelated")


def q_stratified_split(spark, sf):
    return _s2split(spark, sf).select("row_id", "label", "split")


def q_encode_tokens(spark, sf):
    # the prepared training set is read twice (vocabulary, encoding): write
    # it once to the shared checkpoint folder instead of recomputing it
    split = _s2split(spark, sf).select("row_id", "text", "label").checkpoint(eager=True)
    vocab = T.learn_vocabulary(split, "text", size=2000)
    enc = T.encode_tokens(split, vocab, "text", carry=("label",))
    return enc.select("row_id", "label", F.array_join("input_ids", " ").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attention_len"))


# --- metrics -----------------------------------------------------------------

def q_metrics_binary(spark, sf):
    e = L.keyword_relevance(_texts(spark, sf))
    lab = read_table(spark, sf, "labels", ["doc_id", "quality"])
    y = lab.join(e.select("row_id", "is_related"), lab.doc_id == e.row_id).select(
        F.col("quality").alias("label"), F.col("is_related").cast("int").alias("prediction"))
    return _rounded(M.binary_metrics(y), "accuracy", "precision", "recall", "f1")


def q_metrics_weighted(spark, sf):
    d = L.with_scores(_texts(spark, sf), "textOriginal")
    from ..functions.labels import first_hit_of, label_of
    y = d.select(label_of(L.SCORES).alias("label"), first_hit_of(L.SCORES).alias("prediction"))
    return _rounded(M.weighted_metrics(y), "accuracy", "precision", "recall", "f1")


# --- SOE ---------------------------------------------------------------------

def q_category_soe(spark, sf):
    return _rounded(S.category_soe(_e(spark, sf)), "current_soe")


def q_soe_scenarios(spark, sf):
    e = _e(spark, sf)
    return _rounded(S.soe_scenarios(e, S.derived_scenarios(e)),
                    "current_soe", "projected_soe", "delta_soe", "relative_delta")


# --- streaming ---------------------------------------------------------------

def q_stream_enrich(spark, sf):
    from ..streaming.enrich import run_enrich_stream
    return run_enrich_stream(spark, sf)


def q_dashboard_cached(spark, sf):
    from .dashboard import cached_volume
    return cached_volume(spark, sf)


def q_stream_trend(spark, sf):
    from ..streaming.trend import run_trend_stream
    return run_trend_stream(spark, sf)


# --- Spark ML (rows-only) ------------------------------------------------------

def q_train_relevance(spark, sf):
    from ..operators.ml import train_relevance
    return train_relevance(spark, sf)


def q_train_category(spark, sf):
    from ..operators.ml import train_category
    return train_category(spark, sf)


def q_evaluate_holdout(spark, sf):
    from ..operators.ml import evaluate_holdout
    return evaluate_holdout(spark, sf)


def q_evaluate_relevance(spark, sf):
    from ..operators.ml import evaluate_relevance
    return evaluate_relevance(spark, sf)


def q_gated_ml(spark, sf):
    from ..operators.ml import gated_ml
    return gated_ml(spark, sf)


def q_best_candidate(spark, sf):
    from ..operators.ml import best_candidate
    return best_candidate(spark, sf)


def queries() -> dict[str, Query]:
    return {name[2:]: fn for name, fn in globals().items()
            if name.startswith("q_") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    names = set(queries())
    return {k: v for k, v in O.oracle_sql().items() if k in names}
