"""Training-data preparation: spam flags, weak labels, label ids, class
balance, stratified split, fixed-length token encoding.

Splits and samples are exact and repeatable: rows are ordered by
md5('<seed>:<row_id>'), and the first ``n`` per class are found with the
histogram method of ``sampling`` (no class is ever gathered in one task).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import MAX_TOKENS, PRODUCT_RELATED, NOT_PRODUCT_RELATED, UNLABELED
from ..functions.text import normalize_text, tokens
from .labelling import weak_labels
from .sampling import seeded_hash, select_first_n

URL_PATTERN = r"(https?://|www\.)"
EMAIL_PATTERN = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
MIN_CHARS = 20
SEED = 42
TEST_FRACTION = 0.2

PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4


def training_source(enriched: DataFrame) -> DataFrame:
    """(row_id, cleaned_text, isProductRelated int) from the enriched table;
    rows without a relevance label are dropped."""
    rel = (F.when(F.col("isProductRelated") == PRODUCT_RELATED, F.lit(1))
           .when(F.col("isProductRelated") == NOT_PRODUCT_RELATED, F.lit(0)))
    return (enriched.select("row_id", normalize_text("textOriginal").alias("cleaned_text"),
                            rel.alias("isProductRelated"))
            .filter(F.col("isProductRelated").isNotNull()))


def train_columns(source: DataFrame, related_only: bool = False) -> DataFrame:
    """Project to (text, label) like the notebook; optionally related only."""
    if related_only:
        source = source.filter(F.col("isProductRelated") == 1)
    return (source.select("row_id", "cleaned_text", "isProductRelated")
            .withColumnsRenamed({"cleaned_text": "text", "isProductRelated": "label"})
            .na.drop(subset=["text"]))


def spam_flags(df: DataFrame, text: str = "textOriginal", key: str = "row_id",
               min_chars: int = MIN_CHARS) -> DataFrame:
    """Our spam rules (the reference names the step only): URL or e-mail,
    normalized text shorter than ``min_chars``, and exact duplicates of the
    normalized text (every copy after the one with the lowest row id).

    Duplicates: count per text digest with a partial aggregate (a text
    repeated a third of all rows is reduced inside each task), keep only
    digests seen more than once, and join that table back (AQE broadcasts it
    if it is small and splits skewed partitions if not).
    """
    norm = normalize_text(F.col(text))
    d = df.select(key, text, norm.alias("cleaned_text"),
                  F.sha2(norm, 256).alias("_digest"))
    dups = (d.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first"))
            .filter(F.col("_n") > 1).select("_digest", "_first"))
    d = d.join(dups, "_digest", "left")
    low = F.lower(F.col(text))
    return d.select(
        key, "cleaned_text",
        F.coalesce(low.rlike(URL_PATTERN) | low.rlike(EMAIL_PATTERN), F.lit(False)).alias("is_url"),
        (F.length("cleaned_text") < min_chars).alias("is_short"),
        (F.col("_first").isNotNull() & (F.col(key) != F.col("_first"))).alias("is_duplicate"),
    ).withColumn("is_spam", F.col("is_url") | F.col("is_short") | F.col("is_duplicate"))


def remove_spam(df: DataFrame, text: str = "textOriginal", key: str = "row_id") -> DataFrame:
    return spam_flags(df, text, key).filter(~F.col("is_spam")).select(key, "cleaned_text")


def stage2_labelled(source: DataFrame) -> DataFrame:
    """Related rows with their weak category (unlabeled included)."""
    related = source.filter(F.col("isProductRelated") == 1).select("row_id", "cleaned_text")
    return weak_labels(related, "cleaned_text", "category")


def label_ids(labelled: DataFrame, column: str = "category", order: str = "row_id") -> DataFrame:
    """(category, label) with ids in first-appearance order (lowest row id
    first), over labelled rows.  The window runs over one row per category."""
    firsts = (labelled.filter(F.col(column) != UNLABELED)
              .groupBy(column).agg(F.min(order).alias("_first")))
    return firsts.select(column, (F.row_number().over(Window.orderBy("_first")) - 1)
                         .cast("int").alias("label"))


def label_encode(labelled: DataFrame, ids: DataFrame, column: str = "category") -> DataFrame:
    """Map category -> int id.  ``ids`` has one row per category of the
    lexicon (a bound fixed by the lexicon), so it is broadcast."""
    return (labelled.filter(F.col(column) != UNLABELED)
            .join(F.broadcast(ids), column, "inner"))


def label_decode(df: DataFrame, ids: DataFrame, model_label: str = "model_label",
                 out: str = "decoded") -> DataFrame:
    """'LABEL_n' -> category name via the stored id table."""
    idx = F.split(F.col(model_label), "_").getItem(1).cast("int")
    m = ids.select(F.col("label").alias("_id"), F.col("category").alias(out))
    return df.withColumn("_id", idx).join(F.broadcast(m), "_id", "left").drop("_id")


def balance_classes(df: DataFrame, label: str = "isProductRelated", key: str = "row_id",
                    seed: int = SEED) -> DataFrame:
    """Down-sample every class to the size of the smallest class; which rows
    are kept is decided by md5('<seed>:<key>')."""
    d = df.withColumn("_h", seeded_hash(seed, key))

    def need(sizes: DataFrame) -> DataFrame:
        # one row per class: the window spans the (tiny) class table only
        return sizes.withColumn("need", F.min("size").over(Window.partitionBy()))

    return select_first_n(d, label, "_h", key, need).drop("_h")


def stratified_split(df: DataFrame, label: str = "label", key: str = "row_id",
                     test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Add ``split`` ('test' / 'train'): per class exactly
    ceil(test_fraction * class size) rows go to test."""
    d = df.withColumn("_h", seeded_hash(seed, key))

    def need(sizes: DataFrame) -> DataFrame:
        return sizes.withColumn("need", F.ceil(F.col("size") * F.lit(test_fraction)))

    out = select_first_n(d, label, "_h", key, need, flag="_test")
    return out.withColumn("split", F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))) \
              .drop("_test", "_h")


def learn_vocabulary(df: DataFrame, text: str = "text", size: int = 2000) -> DataFrame:
    """(term, id): the ``size`` most frequent terms (ties by term) over whole
    texts, ids from FIRST_WORD_ID on.  Top-``size`` is a
    TakeOrderedAndProject (per-task top, then merge); the numbering window
    runs over those ``size`` rows only."""
    counts = (df.select(F.explode(tokens(F.col(text))).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    top = counts.orderBy(F.desc("n"), F.asc("term")).limit(size)
    return top.select("term", (F.row_number().over(Window.orderBy(F.desc("n"), F.asc("term")))
                               + FIRST_WORD_ID - 1).cast("int").alias("id"))


def _lookup(vocab: DataFrame):
    """Term -> id (null for others) as a literal table of ``term`` and ``id``."""
    rows = vocab.select("term", "id", F.hash("term").alias("h")).collect()  # as many as the vocabulary was asked for
    slots = 1 << max(1, len(rows)).bit_length()
    table: list[dict[str, int]] = [{} for _ in range(slots)]
    for r in rows:
        table[r.h % slots][r.term] = r.id
    literal = F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")  # folded to a constant by the planner
    return lambda t: F.element_at(F.get(literal, F.pmod(F.hash(t), F.lit(slots))), t)


def encode_tokens(df: DataFrame, vocab: DataFrame, text: str = "text", key: str = "row_id",
                  carry: tuple[str, ...] = (), max_length: int = MAX_TOKENS) -> DataFrame:
    """Fixed-length encoding: [CLS] + ids of the first max_length-2 tokens +
    [SEP], padded with [PAD]; unknown terms -> [UNK].  Adds ``input_ids`` and
    ``attention_mask`` (arrays of ``max_length`` ints).

    The vocabulary (its size is a parameter of ``learn_vocabulary``) becomes a
    literal hash table, an array of small maps, that every token looks itself
    up in: one projection, no explode and no exchange.
    """
    body = max_length - 2
    find = _lookup(vocab)
    found = df.select(key, *carry, F.transform(
        F.slice(tokens(F.col(text)), 1, body), lambda t: F.coalesce(find(t), F.lit(UNK_ID))).alias("_ids"))
    ids = F.coalesce("_ids", F.array().cast("array<int>"))
    n = F.size(ids)
    input_ids = F.concat(F.array(F.lit(CLS_ID)), ids, F.array(F.lit(SEP_ID)),
                         F.array_repeat(F.lit(PAD_ID), F.lit(body) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n + 2), F.array_repeat(F.lit(0), F.lit(body) - n))
    return found.select(key, *carry, input_ids.alias("input_ids"), mask.alias("attention_mask"))
