"""Independent SQL (DuckDB dialect) for every SQL-checkable query.

The comment view is built the way FIXTURES.md lays it down, with the
lexicon applied in *join form* (comments x lexicon on ``contains``) and
ranks by window functions; the Spark side uses native expressions and the
histogram sampler.  Equal results from both are the correctness check.
"""

from __future__ import annotations

from ..functions.fixed_values import (BRANDS, CATEGORY_KEYWORDS, NO_BRAND, lexicon_rows)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    out = []
    for r in rows:
        out.append("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")")
    return ",\n    ".join(out)


LEXICON_SQL = f"lexicon(kw_id, cat_rank, category, keyword) AS (VALUES\n    {_values(lexicon_rows())})"
BRANDS_SQL = f"brands(brand_id, brand) AS (VALUES\n    {_values(list(enumerate(BRANDS)))})"
TERMS_SQL = "terms(term) AS (SELECT keyword FROM lexicon UNION SELECT brand FROM brands)"
N_KW = len(lexicon_rows())
N_BRANDS = len(BRANDS)
CATS = list(CATEGORY_KEYWORDS)

NORM = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def norm(x: str) -> str:
    return NORM.format(x=x)


BASE = f"""
WITH {LEXICON_SQL},
{BRANDS_SQL},
{TERMS_SQL},
comments AS (
  SELECT d.doc_id AS row_id, d.source AS videoId,
    d.text || CASE WHEN d.doc_id % 5 <> 0 THEN concat(' ', l.keyword) ELSE '' END
      || CASE WHEN d.doc_id % 7 = 0 THEN concat(' ', upper(b.brand)) ELSE '' END AS textOriginal,
    CASE WHEN d.doc_id % 17 = 0 THEN 'bad' ELSE CAST(d.n_chars % 50 AS VARCHAR) END AS likeCount_comment
  FROM documents d
  JOIN lexicon l ON l.kw_id = d.doc_id % {N_KW}
  JOIN brands b ON b.brand_id = d.doc_id % {N_BRANDS}),
videos AS (
  SELECT source AS videoId,
    CAST(CASE WHEN v % 7 = 0 THEN 0 ELSE v * 1000 END AS BIGINT) AS likeCount_video,
    CAST(CASE WHEN v % 7 = 0 THEN 0 ELSE v * 10 END AS BIGINT) AS favouriteCount,
    CAST(CASE WHEN v % 7 = 0 THEN 0 ELSE n END AS BIGINT) AS commentCount
  FROM (SELECT source, CAST(substr(source, 4) AS INTEGER) AS v, count(*) AS n FROM documents GROUP BY source) s),
scored AS (
  SELECT row_id, category, cat_rank, count(*) AS score
  FROM comments JOIN lexicon ON contains(lower(textOriginal), keyword)
  WHERE textOriginal IS NOT NULL GROUP BY row_id, category, cat_rank),
best AS (
  SELECT row_id, category FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, cat_rank) AS rn FROM scored) s
  WHERE rn = 1),
related AS (
  SELECT c.row_id, bool_or(t.term IS NOT NULL) AS rel
  FROM comments c LEFT JOIN terms t ON contains(lower(c.textOriginal), t.term)
  GROUP BY c.row_id),
sentiment AS (
  SELECT doc_id AS row_id,
    CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
         WHEN quality = 0 THEN 'neutral' END AS predicted_sentiment
  FROM labels),
enriched AS (
  SELECT c.row_id, c.videoId, c.textOriginal,
    coalesce(try_cast(c.likeCount_comment AS DOUBLE), 0) AS likeCount_comment,
    CAST(coalesce(v.likeCount_video, 0) AS DOUBLE) AS likeCount_video,
    CAST(coalesce(v.favouriteCount, 0) AS DOUBLE) AS favouriteCount,
    CAST(coalesce(v.commentCount, 0) AS DOUBLE) AS commentCount,
    CASE WHEN c.row_id % 53 = 5 THEN NULL WHEN b.category IS NULL THEN 'Not Product Related'
         ELSE 'Product Related' END AS isProductRelated,
    coalesce(b.category, '[Not Applicable]') AS Predicted_Category,
    coalesce(s.predicted_sentiment, 'others') AS predicted_sentiment
  FROM comments c LEFT JOIN videos v ON c.videoId = v.videoId
  LEFT JOIN best b ON c.row_id = b.row_id LEFT JOIN sentiment s ON s.row_id = c.row_id
  WHERE c.textOriginal IS NOT NULL),
e AS (
  SELECT *, CASE WHEN (likeCount_video + favouriteCount + commentCount) <> 0
                 THEN likeCount_comment / (likeCount_video + favouriteCount + commentCount)
                 ELSE 0.0 END AS comment_share_of_engagement
  FROM enriched),
p AS (SELECT * FROM e WHERE isProductRelated = 'Product Related'),
src AS (
  SELECT row_id, {norm('textOriginal')} AS cleaned_text,
    CASE isProductRelated WHEN 'Product Related' THEN 1 WHEN 'Not Product Related' THEN 0 END AS isProductRelated
  FROM e WHERE isProductRelated IS NOT NULL),
s2scored AS (
  SELECT row_id, category, cat_rank, count(*) AS score
  FROM src JOIN lexicon ON contains(lower(cleaned_text), keyword)
  WHERE isProductRelated = 1 GROUP BY row_id, category, cat_rank),
s2 AS (
  SELECT r.row_id, r.cleaned_text, coalesce(b.category, 'unlabeled') AS category
  FROM (SELECT * FROM src WHERE isProductRelated = 1) r
  LEFT JOIN (SELECT row_id, category FROM (
      SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, cat_rank) AS rn FROM s2scored) x
    WHERE rn = 1) b ON r.row_id = b.row_id),
label_ids AS (
  SELECT category, CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS INTEGER) AS label
  FROM s2 WHERE category <> 'unlabeled' GROUP BY category),
s2enc AS (
  SELECT s2.row_id, s2.cleaned_text AS text, s2.category, li.label
  FROM s2 JOIN label_ids li ON s2.category = li.category),
s2split AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', CAST(row_id AS VARCHAR))), row_id)
                      <= ceil(0.2 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split
  FROM s2enc)
"""


def q(body: str) -> str:
    return BASE + body


CARD = "row_id, Predicted_Category, predicted_sentiment, likeCount_comment, textOriginal"

EXPLORER_RELEVANCE = ["Product Related", None]
EXPLORER_CATEGORIES = ["[Not Applicable]", "fragrance", "haircare", "haircolor", "skincare"]
EXPLORER_SENTIMENTS = ["positive", "negative", "others"]
SEARCH_TERM = "gel"


def _isin_sql(col: str, values) -> str:
    concrete = [v for v in values if v is not None]
    parts = []
    if concrete:
        parts.append(f"{col} IN ({', '.join(_q(v) for v in concrete)})")
    if any(v is None for v in values):
        parts.append(f"{col} IS NULL")
    return "(" + (" OR ".join(parts) if parts else "FALSE") + ")"


EXPLORER_MASK_SQL = " AND ".join([
    _isin_sql("isProductRelated", EXPLORER_RELEVANCE),
    _isin_sql("Predicted_Category", EXPLORER_CATEGORIES),
    _isin_sql("predicted_sentiment", EXPLORER_SENTIMENTS)])

ROUND = "round({x}, 9)"


def r9(x: str) -> str:
    return ROUND.format(x=x)


#: Relevance of texts that are not blank; null otherwise.
RELATED2 = r"""related2 AS (SELECT c.row_id, CASE WHEN regexp_matches(c.textOriginal, '\S') THEN x.rel END AS rel
  FROM comments c JOIN related x ON c.row_id = x.row_id)"""

SCENARIO_SQL = """
totals AS (
  SELECT Predicted_Category AS category,
    CAST(trunc(sum(likeCount_comment)) AS BIGINT) AS current_comment_likes,
    CAST(trunc(sum(likeCount_video)) AS BIGINT) AS current_video_likes,
    CAST(trunc(sum(favouriteCount)) AS BIGINT) AS current_video_favs,
    CAST(trunc(sum(commentCount)) AS BIGINT) AS current_video_comments
  FROM p GROUP BY Predicted_Category),
plans(plan, m_likes, m_vlikes, m_favs, m_comments) AS (VALUES
  (0, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE),
  (1, 2.0, NULL, NULL, NULL),
  (2, 1.0, 1.5, 1.0, 1.0),
  (3, 0.0, 0.0, 0.0, 0.0)),
scen AS (
  SELECT t.category, pl.plan,
    CAST(floor(t.current_comment_likes * pl.m_likes) AS BIGINT) AS proj_comment_likes,
    CAST(floor(t.current_video_likes * pl.m_vlikes) AS BIGINT) AS proj_video_likes,
    CAST(floor(t.current_video_favs * pl.m_favs) AS BIGINT) AS proj_video_favs,
    CAST(floor(t.current_video_comments * pl.m_comments) AS BIGINT) AS proj_video_comments
  FROM totals t, plans pl WHERE t.category <> '[Not Applicable]'
  UNION ALL SELECT 'None', 10, 500, 1000, 100, 50
  UNION ALL SELECT 'unknown category', 11, NULL, NULL, NULL, NULL
  UNION ALL SELECT 'None', 12, -1, 10, 10, 10),
sc AS (
  SELECT concat_ws('#', s.category, CAST(s.plan AS VARCHAR)) AS scenario_id, s.category,
    coalesce(t.current_comment_likes, 0) AS current_comment_likes,
    coalesce(t.current_video_likes, 0) AS current_video_likes,
    coalesce(t.current_video_favs, 0) AS current_video_favs,
    coalesce(t.current_video_comments, 0) AS current_video_comments,
    coalesce(s.proj_comment_likes, t.current_comment_likes, 0) AS proj_comment_likes,
    coalesce(s.proj_video_likes, t.current_video_likes, 0) AS proj_video_likes,
    coalesce(s.proj_video_favs, t.current_video_favs, 0) AS proj_video_favs,
    coalesce(s.proj_video_comments, t.current_video_comments, 0) AS proj_video_comments
  FROM scen s LEFT JOIN totals t ON s.category = t.category),
sc2 AS (
  SELECT *,
    (proj_comment_likes >= 0 AND proj_video_likes >= 0 AND proj_video_favs >= 0 AND proj_video_comments >= 0) AS valid,
    current_video_likes + current_video_favs + current_video_comments AS current_engagement,
    proj_video_likes + proj_video_favs + proj_video_comments AS projected_engagement
  FROM sc),
sc3 AS (
  SELECT *,
    CASE WHEN current_engagement > 0 THEN CAST(current_comment_likes AS DOUBLE) / current_engagement ELSE 0.0 END AS cur_soe,
    CASE WHEN NOT valid THEN NULL WHEN projected_engagement > 0
         THEN CAST(proj_comment_likes AS DOUBLE) / projected_engagement ELSE 0.0 END AS proj_soe
  FROM sc2)
"""


def oracle_sql() -> dict[str, str]:
    cats_cols = ",\n    ".join(
        f"CAST(coalesce(sum(CASE WHEN s.category = {_q(c)} THEN s.score END), 0) AS BIGINT) AS score_{c}"
        for c in CATS)
    sql = {
        # --- sources / joins -------------------------------------------------
        "integrate_videos": q("""
SELECT c.row_id, c.videoId, v.likeCount_video, v.favouriteCount, v.commentCount
FROM comments c LEFT JOIN videos v ON c.videoId = v.videoId"""),
        "scan_csv_dir": q("""
SELECT row_id, textOriginal, isProductRelated, Predicted_Category, predicted_sentiment,
  likeCount_comment, likeCount_video, favouriteCount, commentCount, comment_share_of_engagement FROM e"""),
        "scan_csv_large": q("""
SELECT row_id, textOriginal, isProductRelated, Predicted_Category, predicted_sentiment,
  likeCount_comment, likeCount_video, favouriteCount, commentCount, comment_share_of_engagement FROM e"""),
        "scan_csv_rejects": q("""
, r AS (SELECT row_id, textOriginal, CAST(2 + length(textOriginal) - length(replace(textOriginal, ',', '')) AS INTEGER) AS n,
          NOT contains(textOriginal, '"') AND NOT contains(textOriginal, chr(10)) AND NOT contains(textOriginal, chr(13))
          AND contains(textOriginal, ',') AS careless
        FROM comments WHERE textOriginal IS NOT NULL)
SELECT row_id, CASE WHEN NOT careless THEN textOriginal END AS textOriginal, CASE WHEN careless THEN n END AS n_cells,
  CASE WHEN careless THEN 'more cells than the header' END AS reason FROM r"""),
        "integrate_raw": q("""
SELECT c.videoId, c.row_id, c.likeCount_comment, v.likeCount_video, v.favouriteCount, v.commentCount
FROM comments c LEFT JOIN videos v ON c.videoId = v.videoId"""),
        "parquet_exact_chunks": q("""
, n AS (SELECT count(*) AS n FROM e)
SELECT CAST(100 AS BIGINT) AS rows, n // 100 AS files FROM n WHERE n >= 100
UNION ALL SELECT n % 100, CAST(1 AS BIGINT) FROM n WHERE n % 100 > 0"""),
        "keyword_hits_large": q("""
, w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark WHERE text IS NOT NULL),
phrases AS (SELECT DISTINCT array_to_string(list_slice(w, i, i + n - 1), ' ') AS term
            FROM w, range(1, 7) AS s(n), range(1, greatest(len(w) - n + 1, 1) + 1) AS r(i) WHERE len(w) > 0),
hits AS (SELECT row_id, count(*) AS n, md5(string_agg(term, ',' ORDER BY term)) AS m
         FROM comments JOIN phrases ON contains(lower(textOriginal), term) GROUP BY row_id)
SELECT c.row_id, coalesce(h.n, 0)::BIGINT AS n_hits, coalesce(h.m, md5('')) AS hits_md5
FROM comments c LEFT JOIN hits h ON c.row_id = h.row_id WHERE c.textOriginal IS NOT NULL"""),
        "dashboard_cached": q("""
SELECT Predicted_Category, count(*) AS comments, CAST(sum(likeCount_comment) AS BIGINT) AS likes
FROM p WHERE Predicted_Category <> '[Not Applicable]' GROUP BY Predicted_Category"""),
        "export_filtered": q(f"""
SELECT row_id, textOriginal, isProductRelated, Predicted_Category, predicted_sentiment, likeCount_comment
FROM e WHERE {EXPLORER_MASK_SQL}"""),
        "parquet_chunks": q("""
SELECT row_id, isProductRelated, Predicted_Category, predicted_sentiment, comment_share_of_engagement FROM e"""),
        "union_by_name": q("""
SELECT row_id, Predicted_Category, likeCount_comment FROM e WHERE isProductRelated = 'Product Related'
UNION ALL BY NAME
SELECT row_id, predicted_sentiment, likeCount_comment, isProductRelated FROM e
WHERE isProductRelated IS DISTINCT FROM 'Product Related'"""),
        # --- cleaning ----------------------------------------------------------
        "drop_missing_text": q("SELECT row_id, textOriginal FROM comments WHERE textOriginal IS NOT NULL AND row_id % 40 <> 7"),
        "fill_labels": q("SELECT row_id, Predicted_Category, predicted_sentiment FROM e"),
        "coerce_counts": q("SELECT row_id, likeCount_comment, likeCount_video, favouriteCount, commentCount FROM e"),
        "require_columns": q("""
SELECT row_id, coalesce(try_cast(likeCount_comment AS DOUBLE), 0) AS likeCount_comment,
  CAST(0.0 AS DOUBLE) AS likeCount_video, CAST(0.0 AS DOUBLE) AS favouriteCount,
  CAST(0.0 AS DOUBLE) AS commentCount
FROM comments WHERE textOriginal IS NOT NULL"""),
        "share_of_engagement": q("SELECT row_id, comment_share_of_engagement FROM e"),
        "normalize_text": q(f"SELECT row_id, {norm('textOriginal')} AS cleaned_text FROM e"),
        "keyword_hits": q("SELECT row_id, category, CAST(cat_rank AS BIGINT) AS cat_rank, CAST(score AS BIGINT) AS score FROM scored"),
        "brand_tags": q(f"""
SELECT e.row_id, coalesce(string_agg(b.brand, ', ' ORDER BY b.brand_id), {_q(NO_BRAND)}) AS brands
FROM e LEFT JOIN brands b ON contains(lower(e.textOriginal), b.brand)
GROUP BY e.row_id"""),
        "display_labels": q("""
SELECT row_id,
  upper(substr(Predicted_Category, 1, 1)) || lower(substr(Predicted_Category, 2)) AS category_display,
  upper(substr(predicted_sentiment, 1, 1)) || lower(substr(predicted_sentiment, 2)) AS sentiment_display
FROM p WHERE Predicted_Category <> '[Not Applicable]'"""),
        "soe_display": q(f"""
, t AS (
  SELECT Predicted_Category,
    CAST(trunc(sum(likeCount_comment)) AS BIGINT) AS l,
    CAST(trunc(sum(likeCount_video)) AS BIGINT) + CAST(trunc(sum(favouriteCount)) AS BIGINT)
      + CAST(trunc(sum(commentCount)) AS BIGINT) AS d
  FROM p GROUP BY Predicted_Category)
SELECT Predicted_Category,
  printf('%.4f%%', CASE WHEN d > 0 THEN CAST(l AS DOUBLE) / d ELSE 0.0 END * 100) AS current_soe_text,
  format('{{:,}}', l) AS current_likes_text,
  format('{{:,}}', d) AS current_engagement_text
FROM t"""),
        "label_ids": q("SELECT category, label FROM label_ids"),
        "label_encode": q("SELECT row_id, text, label FROM s2enc"),
        "label_decode": q("SELECT row_id, concat('LABEL_', CAST(label AS VARCHAR)) AS model_label, category AS decoded FROM s2enc"),
        "train_columns": q("SELECT row_id, cleaned_text AS text, isProductRelated AS label FROM src"),
        # --- filters -----------------------------------------------------------
        "product_comments": q(f"SELECT {CARD} FROM p"),
        "explorer_filter": q(f"""
SELECT row_id, isProductRelated, Predicted_Category, predicted_sentiment, likeCount_comment
FROM e WHERE {EXPLORER_MASK_SQL}"""),
        "explorer_search": q(f"""
SELECT row_id, Predicted_Category, predicted_sentiment FROM e
WHERE contains(lower(textOriginal), {_q(SEARCH_TERM)}) OR contains(lower(videoId), {_q(SEARCH_TERM)})
   OR contains(lower(isProductRelated), {_q(SEARCH_TERM)}) OR contains(lower(Predicted_Category), {_q(SEARCH_TERM)})
   OR contains(lower(predicted_sentiment), {_q(SEARCH_TERM)})"""),
        "explorer_search_indexed": q(f"""
SELECT row_id, Predicted_Category, predicted_sentiment FROM e
WHERE contains(lower(textOriginal), {_q(SEARCH_TERM)}) OR contains(lower(videoId), {_q(SEARCH_TERM)})
   OR contains(lower(isProductRelated), {_q(SEARCH_TERM)}) OR contains(lower(Predicted_Category), {_q(SEARCH_TERM)})
   OR contains(lower(predicted_sentiment), {_q(SEARCH_TERM)})"""),
        "spam_filter": q(f"""
, n AS (SELECT row_id, textOriginal, {norm('textOriginal')} AS cleaned_text FROM e),
d AS (SELECT *, count(*) OVER (PARTITION BY cleaned_text) AS cnt,
             min(row_id) OVER (PARTITION BY cleaned_text) AS first_id FROM n)
SELECT row_id, cleaned_text,
  coalesce(regexp_matches(lower(textOriginal), '(https?://|www\\.)')
           OR regexp_matches(lower(textOriginal), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}'), FALSE) AS is_url,
  length(cleaned_text) < 20 AS is_short,
  (cnt > 1 AND row_id <> first_id) AS is_duplicate,
  (coalesce(regexp_matches(lower(textOriginal), '(https?://|www\\.)')
           OR regexp_matches(lower(textOriginal), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}'), FALSE)
   OR length(cleaned_text) < 20 OR (cnt > 1 AND row_id <> first_id)) AS is_spam
FROM d"""),
        "spam_removed": q(f"""
, n AS (SELECT row_id, lower(textOriginal) AS low, {norm('textOriginal')} AS cleaned_text FROM e),
d AS (SELECT *, row_number() OVER (PARTITION BY cleaned_text ORDER BY row_id) AS copy FROM n)
SELECT row_id, cleaned_text FROM d
WHERE copy = 1 AND length(cleaned_text) >= 20 AND NOT regexp_matches(low, '(https?://|www\\.)')
  AND NOT regexp_matches(low, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}')"""),
        "parquet_file_bound": q("SELECT TRUE AS within_bound, CAST(count(*) AS BIGINT) AS rows FROM e"),
        # --- aggregates --------------------------------------------------------
        "sentiment_overview": q("SELECT predicted_sentiment, count(*) AS count FROM e GROUP BY 1"),
        "relevance_ratio": q("SELECT isProductRelated, count(*) AS count FROM e WHERE isProductRelated IS NOT NULL GROUP BY 1"),
        "category_volume": q("SELECT Predicted_Category, count(*) AS count FROM p WHERE Predicted_Category <> '[Not Applicable]' GROUP BY 1"),
        "sentiment_by_category": q("SELECT Predicted_Category, predicted_sentiment, count(*) AS count FROM p GROUP BY 1, 2"),
        "mean_soe_by_category": q(f"""
SELECT Predicted_Category, {r9('avg(comment_share_of_engagement)')} AS mean_soe FROM p GROUP BY 1
HAVING avg(comment_share_of_engagement) IS NOT NULL"""),
        "category_totals": q("""
SELECT Predicted_Category,
  CAST(trunc(sum(likeCount_comment)) AS BIGINT) AS current_comment_likes,
  CAST(trunc(sum(likeCount_video)) AS BIGINT) AS current_video_likes,
  CAST(trunc(sum(favouriteCount)) AS BIGINT) AS current_video_favs,
  CAST(trunc(sum(commentCount)) AS BIGINT) AS current_video_comments
FROM p GROUP BY 1"""),
        "category_options": q("SELECT DISTINCT Predicted_Category FROM p WHERE Predicted_Category <> '[Not Applicable]'"),
        "filter_options": q("""
SELECT DISTINCT 'isProductRelated' AS filter_column, isProductRelated AS value FROM e
UNION ALL SELECT DISTINCT 'Predicted_Category', Predicted_Category FROM e
UNION ALL SELECT DISTINCT 'predicted_sentiment', predicted_sentiment FROM e"""),
        "explorer_counts": q(f"""
SELECT CAST(count(*) FILTER (WHERE {EXPLORER_MASK_SQL}) AS BIGINT) AS shown_rows,
       CAST(count(*) AS BIGINT) AS total_rows FROM e"""),
        "weak_labels": q("SELECT row_id, category FROM s2 WHERE category <> 'unlabeled'"),
        "weak_label_distribution": q("SELECT category, count(*) AS count FROM s2 GROUP BY 1"),
        "weak_label_coverage": q("""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE category <> 'unlabeled') AS labelled_rows,
       count(*) FILTER (WHERE category = 'unlabeled') AS dropped_rows FROM s2"""),
        "category_examples": q("""
SELECT category, arg_min(cleaned_text, row_id) AS example_text, min(row_id) AS example_row_id
FROM s2 WHERE category <> 'unlabeled' GROUP BY 1"""),
        "category_scores": q(f"""
SELECT e.row_id,
    {cats_cols}
FROM e LEFT JOIN scored s ON e.row_id = s.row_id GROUP BY e.row_id"""),
        "top_terms": q(f"""
, toks AS (SELECT unnest(string_split({norm('textOriginal')}, ' ')) AS term FROM e
           WHERE {norm('textOriginal')} <> '')
SELECT term, count(*) AS count FROM toks GROUP BY term ORDER BY count DESC, term LIMIT 50"""),
        # --- top-k ------------------------------------------------------------
        "top_liked_one": q(f"""
SELECT {CARD} FROM p WHERE Predicted_Category = 'skincare'
ORDER BY likeCount_comment DESC NULLS LAST, row_id LIMIT 5"""),
        "top_positive": q(f"""
SELECT {CARD} FROM p WHERE Predicted_Category = 'skincare' AND predicted_sentiment = 'positive'
ORDER BY likeCount_comment DESC NULLS LAST, row_id LIMIT 5"""),
        "top_negative": q(f"""
SELECT {CARD} FROM p WHERE Predicted_Category = 'makeup' AND predicted_sentiment = 'negative'
ORDER BY likeCount_comment DESC NULLS LAST, row_id LIMIT 5"""),
        "top_liked_all": q(f"""
SELECT {CARD}, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY Predicted_Category
                               ORDER BY likeCount_comment DESC NULLS LAST, row_id) AS rank FROM p) x
WHERE rank <= 5"""),
        "explorer_sort": q("SELECT row_id, likeCount_comment, Predicted_Category FROM e ORDER BY likeCount_comment DESC, row_id"),
        # --- labelling -----------------------------------------------------------
        "keyword_relevance": q("SELECT e.row_id, r.rel AS is_related FROM e JOIN related r ON e.row_id = r.row_id"),
        "gated_pipeline": q("""
SELECT e.row_id, r.rel AS is_related,
  CASE WHEN r.rel THEN coalesce(b.category, 'unlabeled') END AS category,
  CASE WHEN r.rel THEN s.predicted_sentiment END AS sentiment
FROM e JOIN (SELECT c.row_id, CASE WHEN regexp_matches(c.textOriginal, '\\S') THEN x.rel END AS rel
             FROM comments c JOIN related x ON c.row_id = x.row_id) r ON e.row_id = r.row_id
LEFT JOIN best b ON e.row_id = b.row_id LEFT JOIN sentiment s ON e.row_id = s.row_id"""),
        "analyze_comments": q(f"""
, tot AS (SELECT row_id, sum(score) AS total, max(score) AS top FROM scored GROUP BY row_id),
bt AS (SELECT e.row_id, string_agg(b.brand, ', ' ORDER BY b.brand_id) AS brands
       FROM e LEFT JOIN brands b ON contains(lower(e.textOriginal), b.brand) GROUP BY e.row_id),
{RELATED2}
SELECT e.row_id, e.textOriginal AS comment,
  CASE WHEN r.rel THEN 'Yes' WHEN NOT r.rel THEN 'No' ELSE 'N/A' END AS is_related,
  CASE WHEN r.rel THEN coalesce(b.category, 'unlabeled') ELSE 'N/A' END AS category,
  CASE WHEN r.rel THEN coalesce(bt.brands, {_q(NO_BRAND)}) ELSE 'N/A' END AS brands,
  CASE WHEN r.rel IS NOT NULL THEN CAST(1.0 AS DOUBLE) END AS relevance_score,
  CASE WHEN r.rel AND tot.total > 0 THEN CAST(tot.top AS DOUBLE) / tot.total END AS category_score
FROM e JOIN related2 r ON e.row_id = r.row_id
LEFT JOIN best b ON e.row_id = b.row_id LEFT JOIN tot ON e.row_id = tot.row_id
LEFT JOIN bt ON e.row_id = bt.row_id"""),
        "confidence": q("""
, tot AS (SELECT row_id, sum(score) AS total, max(score) AS top FROM scored GROUP BY row_id)
SELECT e.row_id, coalesce(b.category, 'unlabeled') AS category,
  CASE WHEN tot.total > 0 THEN CAST(tot.top AS DOUBLE) / tot.total END AS confidence
FROM e LEFT JOIN best b ON e.row_id = b.row_id LEFT JOIN tot ON e.row_id = tot.row_id"""),
        "argmax_label": """
SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted
FROM embeddings""",
        # --- training data ------------------------------------------------------
        "balance_classes": q("""
, m AS (SELECT min(c) AS need FROM (SELECT isProductRelated, count(*) AS c FROM src GROUP BY 1) x)
SELECT row_id, isProductRelated FROM (
  SELECT row_id, isProductRelated,
    row_number() OVER (PARTITION BY isProductRelated
                       ORDER BY md5(concat('42:', CAST(row_id AS VARCHAR))), row_id) AS rn FROM src) s, m
WHERE rn <= m.need"""),
        "stratified_split": q("SELECT row_id, label, split FROM s2split"),
        "encode_tokens": q("""
, tk AS (SELECT row_id, label, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(text, ' ') END AS t FROM s2split),
allt AS (SELECT row_id, label, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM tk),
cnt AS (SELECT term, count(*) AS n FROM allt GROUP BY term),
vocab AS (SELECT term, id FROM (SELECT term, CAST(row_number() OVER (ORDER BY n DESC, term) + 3 AS INTEGER) AS id FROM cnt) v
          WHERE id <= 2003),
ids AS (SELECT a.row_id, string_agg(CAST(coalesce(v.id, 1) AS VARCHAR), ' ' ORDER BY a.pos) AS ids, count(*) AS n
        FROM allt a LEFT JOIN vocab v ON a.term = v.term WHERE a.pos <= 126 GROUP BY a.row_id)
SELECT tk.row_id, tk.label,
  concat_ws(' ', '2', ids.ids, '3') || repeat(' 0', CAST(126 - coalesce(ids.n, 0) AS INTEGER)) AS input_ids,
  CAST(coalesce(ids.n, 0) + 2 AS INTEGER) AS attention_len
FROM tk LEFT JOIN ids ON tk.row_id = ids.row_id"""),
        # --- metrics --------------------------------------------------------------
        "metrics_binary": q(f"""
, y AS (SELECT l.quality AS label, CASE WHEN r.rel THEN 1 ELSE 0 END AS prediction
        FROM labels l JOIN e ON e.row_id = l.doc_id JOIN related r ON r.row_id = e.row_id),
c AS (SELECT count(*) AS n,
        count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
        count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
        count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn,
        count(*) FILTER (WHERE label = prediction) AS correct FROM y)
SELECT n, tp, fp, fn,
  {r9("CASE WHEN n > 0 THEN CAST(correct AS DOUBLE) / n ELSE 0.0 END")} AS accuracy,
  {r9("CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END")} AS precision,
  {r9("CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END")} AS recall,
  {r9("CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END")} AS f1
FROM c"""),
        "metrics_weighted": q(f"""
, first_hit AS (SELECT row_id, category FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY cat_rank) AS rn FROM scored) x WHERE rn = 1),
y AS (SELECT coalesce(b.category, 'unlabeled') AS label, coalesce(f.category, 'unlabeled') AS prediction
      FROM e LEFT JOIN best b ON e.row_id = b.row_id LEFT JOIN first_hit f ON e.row_id = f.row_id),
cf AS (SELECT label, prediction, count(*) AS n FROM y GROUP BY 1, 2),
sup AS (SELECT label AS cls, sum(n) AS support FROM cf GROUP BY 1),
prd AS (SELECT prediction AS cls, sum(n) AS predicted FROM cf GROUP BY 1),
tp AS (SELECT label AS cls, n AS tp FROM cf WHERE label = prediction),
pc AS (SELECT coalesce(s.cls, p.cls) AS cls, coalesce(s.support, 0) AS support,
              coalesce(p.predicted, 0) AS predicted, coalesce(t.tp, 0) AS tp
       FROM sup s FULL JOIN prd p ON s.cls = p.cls LEFT JOIN tp t ON coalesce(s.cls, p.cls) = t.cls),
pm AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS prec,
              CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS rec,
              CASE WHEN support + predicted > 0 THEN CAST(2 * tp AS DOUBLE) / (support + predicted) ELSE 0.0 END AS f
       FROM pc)
SELECT {r9("CAST(sum(tp) AS DOUBLE) / sum(support)")} AS accuracy,
  {r9("sum(support * prec) / sum(support)")} AS precision,
  {r9("sum(support * rec) / sum(support)")} AS recall,
  {r9("sum(support * f) / sum(support)")} AS f1,
  CAST(sum(support) AS BIGINT) AS n
FROM pm"""),
        # --- SOE ------------------------------------------------------------------
        "category_soe": q(f"""
, t AS (SELECT Predicted_Category,
    CAST(trunc(sum(likeCount_comment)) AS BIGINT) AS current_comment_likes,
    CAST(trunc(sum(likeCount_video)) AS BIGINT) AS current_video_likes,
    CAST(trunc(sum(favouriteCount)) AS BIGINT) AS current_video_favs,
    CAST(trunc(sum(commentCount)) AS BIGINT) AS current_video_comments
  FROM p GROUP BY 1)
SELECT *, current_video_likes + current_video_favs + current_video_comments AS current_engagement,
  {r9("CASE WHEN current_video_likes + current_video_favs + current_video_comments > 0 THEN CAST(current_comment_likes AS DOUBLE) / (current_video_likes + current_video_favs + current_video_comments) ELSE 0.0 END")} AS current_soe
FROM t"""),
        "soe_scenarios": q(", " + SCENARIO_SQL.strip() + f"""
SELECT scenario_id, category, current_comment_likes, current_video_likes, current_video_favs, current_video_comments,
  proj_comment_likes, proj_video_likes, proj_video_favs, proj_video_comments, valid,
  current_engagement, projected_engagement,
  {r9("cur_soe")} AS current_soe, {r9("proj_soe")} AS projected_soe,
  {r9("proj_soe - cur_soe")} AS delta_soe,
  {r9("CASE WHEN cur_soe > 0 THEN (proj_soe - cur_soe) / cur_soe END")} AS relative_delta
FROM sc3"""),
        "scenario_display": q(", " + SCENARIO_SQL.strip() + """
SELECT scenario_id, category,
  printf('%.4f%%', cur_soe * 100) AS current_soe_text, printf('%.4f%%', proj_soe * 100) AS projected_soe_text,
  CASE WHEN cur_soe > 0 THEN printf('%.4f%%', (proj_soe - cur_soe) * 100) || ' (' ||
       printf('%.2f%%', (proj_soe - cur_soe) / cur_soe * 100) || ')' ELSE 'N/A' END AS delta_text,
  format('{:,}', current_comment_likes) AS current_likes_text,
  format('{:,}', current_engagement) AS current_engagement_text
FROM sc3 WHERE valid"""),
        # --- streaming -----------------------------------------------------------
        "stream_enrich": q(f"""
, tot AS (SELECT row_id, sum(score) AS total, max(score) AS top FROM scored GROUP BY row_id),
bt AS (SELECT c.row_id, string_agg(b.brand, ', ' ORDER BY b.brand_id) AS brands
       FROM comments c LEFT JOIN brands b ON contains(lower(c.textOriginal), b.brand) GROUP BY c.row_id),
{RELATED2}
SELECT c.row_id, c.textOriginal AS comment,
  CASE WHEN r.rel THEN 'Yes' WHEN NOT r.rel THEN 'No' ELSE 'N/A' END AS is_related,
  CASE WHEN r.rel THEN coalesce(b.category, 'unlabeled') ELSE 'N/A' END AS category,
  CASE WHEN r.rel THEN coalesce(bt.brands, {_q(NO_BRAND)}) ELSE 'N/A' END AS brands,
  CASE WHEN r.rel IS NOT NULL THEN CAST(1.0 AS DOUBLE) END AS relevance_score,
  CASE WHEN r.rel AND tot.total > 0 THEN CAST(tot.top AS DOUBLE) / tot.total END AS category_score
FROM comments c JOIN related2 r ON c.row_id = r.row_id
LEFT JOIN best b ON c.row_id = b.row_id LEFT JOIN tot ON c.row_id = tot.row_id
LEFT JOIN bt ON c.row_id = bt.row_id"""),
        "stream_trend": """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start,
       time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
       event_type, count(*) AS count
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3""",
    }
    return sql
