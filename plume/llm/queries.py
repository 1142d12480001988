"""The registered queries of the training-data operators (one per operator,
over whole tables) and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plume.llm import (align, chat, decontaminate, licenses, mixing, pieces, pii, quality, repeats, resample, simhash,
                       syncmers, tokens)

#: Said by both rows of conversation -1: text that looks like a template's control strings.
TRICKY = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql(
        "SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM VALUES "
        f"(0, 'user', '{TRICKY}'), (1, 'assistant', '{TRICKY}') AS t(turn, role, text)")
    return chat.digest(rows.unionByName(tricky))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.digest(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return align.digest(_table(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_chat": op4_chat,
    "op5_tokens": op5_tokens,
    "op6_mixing": op6_mixing,
    "op7_syncmers": op7_syncmers,
    "op8_pii": op8_pii,
    "op9_repeats": op9_repeats,
    "op10_licenses": op10_licenses,
    "op11_align": op11_align,
    "op12_pieces": op12_pieces,
    "op13_resample": op13_resample,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
         array_to_string(list_slice(w, i, i + 9), ' ') AS win
  FROM item_words, range(1, greatest(len(w) - 9, 1) + 1) AS r(i) WHERE len(w) > 0),
doc_words AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER.replace('text', "coalesce(text, '')")}, '{_ALNUM}') AS w
  FROM documents),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT k, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM doc_words, sizes, range(1, len(w) - size + 2) AS r(i)),
hits AS (SELECT d.k, d.i, d.size, t.item_id FROM doc_windows d JOIN item_windows t USING (size, win)),
words_hit AS (
  SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS j FROM hits) GROUP BY k),
items_hit AS (
  SELECT k, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN words_hit USING (k) LEFT JOIN items_hit USING (k)""",
    "op4_chat": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}'),
sized AS (
  SELECT *, len(text) + 4 * (len(text) - len(replace(text, '&', ''))) + 3 * (len(text) - len(replace(text, '<', '')))
         + 3 * (len(text) - len(replace(text, '>', ''))) + 4 * (len(text) - len(replace(text, '[', ''))) AS body,
         CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 7
         ELSE 11 + len(role) + 4 * (len(role) - len(replace(role, '&', ''))) + 3 * (len(role) - len(replace(role, '<', '')))
              + 3 * (len(role) - len(replace(role, '>', ''))) + 4 * (len(role) - len(replace(role, '[', ''))) END AS marks
  FROM rows),
done AS (
  SELECT conv_id, count(*) AS n, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(body + marks) AS chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(turns) AS turns_sha256, len(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM done""",
    "op6_mixing": rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
fill AS (  -- shares by weight, again and again, until no source is above three times its size
  SELECT 0 AS round, source, source_size, weight, false AS full FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight,
         "full" OR 3 * source_size * sum(CASE WHEN NOT "full" THEN weight ELSE 0 END) OVER () <=
         (sum(source_size) OVER () - sum(CASE WHEN "full" THEN 3 * source_size ELSE 0 END) OVER ()) * weight
  FROM fill WHERE round < (SELECT count(*) FROM s)),
last AS (SELECT * FROM fill WHERE round = (SELECT count(*) FROM s)),
goals AS (
  SELECT source, source_size, CASE WHEN "full" THEN (3 * source_size)::DOUBLE ELSE
         (sum(source_size) OVER () - sum(CASE WHEN "full" THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE * weight
         / sum(CASE WHEN "full" THEN 0 ELSE weight END) OVER () END AS target FROM last),
queue AS (
  SELECT d.*, source_size, target,  -- each row stands behind all rows before it, repeated ones too
         sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, size, k ROWS UNBOUNDED PRECEDING) - size AS words_before
  FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,  -- a source's words are taken up to its target, three times round at most
       sum(greatest(least(floor(target) - (words_before + source_size * round), size), 0))::BIGINT AS taken
FROM queue, range(3) AS r(round) GROUP BY k, doc_id, size, source_size, target""",
    "op9_repeats": rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
windows AS (
  SELECT k, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS win FROM d, range(1, len(w) - 33) AS r(i)),
repeated AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY win) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS j FROM repeated),
words AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (
  SELECT k, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (k, j) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)""",
}
