"""Column expressions on literal rows: traps T2-T6, tie rules, edge rows."""

import math

from pyspark.sql import functions as F

from plume.functions.fixed_values import NA_TOKENS
from plume.functions.labels import prefix_free_groups
from plume.functions.numeric import coerce_number, percent, ratio_nonzero, ratio_positive, thousands
from plume.functions.text import normalize_text, tokens
from plume.operators.cleaning import na_tokens_to_null
from plume.operators.explorer import isin_with_null
from plume.operators.labelling import analyze_comments, brand_columns, gated_pipeline, keyword_relevance, weak_labels


def test_na_tokens(spark):
    vals = ["NA", "N/A", "null", "None", "nan", "", "none", "Null", " ", "ok"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    out = [r.c for r in na_tokens_to_null(df).collect()]
    assert out[:6] == [None] * 6
    assert out[6:] == ["none", "Null", " ", "ok"]
    assert "" in NA_TOKENS


def test_coerce_number(spark):
    vals = ["1e3", " 5 ", "1,000", "1d", "5f", "0x10", "abc", None, "nan", "-2.5", ".5", "inf"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    out = [r.v for r in df.select(coerce_number("c").alias("v")).collect()]
    assert out[:9] == [1000.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert out[9:11] == [-2.5, 0.5]
    assert math.isinf(out[11])


def test_ratios_guard_division(spark):
    df = spark.createDataFrame([(3.0, 0.0), (3.0, -2.0), (1.0, 4.0)], "n double, d double")
    rows = df.select(ratio_nonzero(F.col("n"), F.col("d")).alias("row"),
                     ratio_positive(F.col("n"), F.col("d")).alias("agg")).collect()
    assert [(r.row, r.agg) for r in rows] == [(0.0, 0.0), (-1.5, 0.0), (0.25, 0.25)]


def test_display_formats(spark):
    df = spark.createDataFrame([(0.0123456, 1234567)], "x double, n long")
    r = df.select(percent(F.col("x"), 4).alias("p"), percent(F.col("x"), 2).alias("q"),
                  thousands(F.col("n")).alias("t")).first()
    assert (r.p, r.q, r.t) == ("1.2346%", "1.23%", "1,234,567")


def test_isin_with_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    assert df.filter(isin_with_null("c", ["a", None])).count() == 2
    assert df.filter(isin_with_null("c", ["a"])).count() == 1
    assert df.filter(isin_with_null("c", [])).count() == 0


def test_normalize_and_tokens(spark):
    df = spark.createDataFrame([("  Hello,   WORLD!! it's 2024 ",), ("",), ("!!!",)], "t string")
    rows = df.select(normalize_text("t").alias("n"), tokens("t").alias("k")).collect()
    assert rows[0].n == "hello world it s 2024"
    assert rows[0].k == ["hello", "world", "it", "s", "2024"]
    assert rows[1].k == [] and rows[2].k == []


def test_weak_label_edge_rows(spark):
    texts = [None, "a new toner", "an angel", "dry shampoo", "lotion and fragrance", "nothing here",
             "Foundation + LIPSTICK", "serum, cream and mascara"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string")
    got = {r.row_id: r.category for r in weak_labels(df, "t", "category").collect()}
    assert got == {0: "unlabeled", 1: "skincare", 2: "haircare", 3: "haircare", 4: "skincare",
                   5: "unlabeled", 6: "makeup", 7: "skincare"}
    hits = {r.row_id: r for r in __import__("plume.operators.labelling", fromlist=["x"])
            .category_score_columns(df, "t").collect()}
    assert hits[3].score_haircare == 2          # "shampoo" and "dry shampoo"
    assert hits[1].score_skincare == 1 and hits[1].score_haircolor == 1


def test_prefix_free_groups():
    groups = prefix_free_groups(["hair", "hair dye", "dye", "hair"])
    assert groups == [["hair dye", "dye"], ["hair"]]
    for g in groups:
        assert not any(a != b and b.startswith(a) for a in g for b in g)


def test_prefix_terms_found_with_extra_terms(spark):
    df = spark.createDataFrame([(1, "my hair dye"), (2, "plain text")], "row_id long, t string")
    rel = {r.row_id: r.is_related for r in keyword_relevance(df, "t", extra_terms=["hair", "plain"]).collect()}
    assert rel == {1: True, 2: True}


# Own sentences: one per category, a tie, an accented brand, a brand with its
# product line, a substring trap, no keyword.
NONE = "Brand Not Specified"
COMMENTS = [
    ("We tested two mascara wands side by side", "makeup", NONE),
    ("My evening routine is a toner and then bed", "skincare", NONE),
    ("Two shampoo bars survived the whole trip", "haircare", NONE),
    ("That perfume reminded us of a train station", "fragrance", NONE),
    ("A lotion and a perfume in one box", "skincare", NONE),
    ("Garnier once more, nothing else to report", "unlabeled", "garnier"),
    ("L'ORÉAL Elvive shampoo went on sale", "haircare", "l'oréal, elvive"),
    ("An angel statue stood in the hall", "haircare", NONE),
    ("The train was late again on Tuesday", "unlabeled", NONE),
]


def test_own_comments(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(COMMENTS)], "row_id long, t string")
    cats = {r.row_id: r.category for r in weak_labels(df, "t", "category").collect()}
    brands = {r.row_id: r.brands for r in brand_columns(df, "t").collect()}
    for i, (_, cat, brand) in enumerate(COMMENTS):
        assert cats[i] == cat, (i, cats[i])
        assert brands[i] == brand, (i, brands[i])
    rec = {r.row_id: r for r in analyze_comments(df, "t").collect()}
    assert rec[6].is_related == "Yes" and rec[6].brands == "l'oréal, elvive"
    assert rec[8].is_related == "No" and rec[8].category == "N/A" and rec[8].category_score is None
    assert rec[4].category_score == 0.5          # lotion 1 : perfume 1


BLANKS = ["   ", "", "\n\t", "\u00a0\u2003", None]


def test_blank_input_is_kept_unclassified(spark):
    df = spark.createDataFrame([*enumerate(BLANKS), (9, "a toner")], "row_id long, t string")
    got = {r.row_id: r for r in analyze_comments(df, "t").collect()}
    assert len(got) == len(BLANKS) + 1 and got[9].is_related == "Yes"
    for i in range(len(BLANKS)):
        assert (got[i].is_related, got[i].category, got[i].brands) == ("N/A", "N/A", "N/A")
        assert got[i].relevance_score is None and got[i].category_score is None
    sentiment = spark.createDataFrame([(0, "positive"), (9, "negative")], "row_id long, predicted_sentiment string")
    gated = {r.row_id: r for r in gated_pipeline(df, sentiment, "t").collect()}
    assert len(gated) == len(BLANKS) + 1
    assert gated[0].is_related is None and gated[0].category is None and gated[0].sentiment is None
    assert gated[9].is_related and gated[9].sentiment == "negative"


def test_percent_rounds_as_python_does(spark):
    values = [0.00125, 0.00375, 0.12345, 1234.5, -0.0001, 0.0, 0.00165, 0.285]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [tuple(r) for r in df.select(percent(F.col("x"), 2), percent(F.col("x"), 4)).collect()]
    assert got == [(f"{v:.2%}", f"{v:.4%}") for v in values]


def test_one_scan_gives_the_labels_of_the_text_and_of_its_normalized_form(spark):
    from pyspark.sql import functions as F

    from plume.functions.fixed_values import UNLABELED
    from plume.functions.text import normalize_text
    from plume.operators.labelling import weak_labels, weak_labels_both

    texts = ["Lip  Gloss", "lip-gloss", "LIP GLOSS", "lip gloss lip\ngloss", "anti-aging", "anti aging", "leave-in leave in", "dry, shampoo",
             "dry shampoo", "hair color-treated", "hair\u00e9dye", "color treated", "hairdye", "spf50 tonertoner", "box'dye roots",
             "sheet mask-clay mask", "hair hair mask hair  oil", "vitamin \U0001f600 c", "vitaminc", "", "  ", "\u0130 serum", "lip", "gloss lip", None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, t string")
    both = weak_labels_both(df, "t", "found", "category")
    plain = weak_labels(weak_labels(df, "t", "_c").withColumn("n", normalize_text("t")), "n", "category")
    ref = plain.select("row_id", "t", (F.col("_c") != UNLABELED).alias("found"), "category")
    assert sorted(map(str, both.collect())) == sorted(map(str, ref.collect()))
