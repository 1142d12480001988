"""Operators on literal tables: top-k ties, cleaning, aggregates, SOE."""

import pytest
from pyspark.sql import functions as F

from plume.operators import aggregates as A
from plume.operators.cleaning import clean
from plume.operators.soe import soe_scenarios
from plume.operators.topk import top_liked, top_liked_all


def _enriched(spark, rows):
    schema = ("row_id long, textOriginal string, isProductRelated string, Predicted_Category string, "
              "predicted_sentiment string, likeCount_comment string, likeCount_video string, "
              "favouriteCount string, commentCount string")
    return clean(spark.createDataFrame(rows, schema))


def test_top5_ties_keep_earlier_rows(spark):
    likes = [5, 9, 9, 1, 9, 9, 9, 2]
    rows = [(i, f"t{i}", "Product Related", "makeup", "positive", str(v), "10", "0", "0")
            for i, v in enumerate(likes)]
    e = _enriched(spark, rows)
    assert [r.row_id for r in top_liked(e, "makeup").collect()] == [1, 2, 4, 5, 6]
    assert sorted(r.row_id for r in top_liked_all(e).collect()) == [1, 2, 4, 5, 6]


def test_top_liked_all_plan_limits_before_shuffle(spark):
    rows = [(i, f"t{i}", "Product Related", "makeup", "positive", str(i), "1", "0", "0") for i in range(20)]
    plan = top_liked_all(_enriched(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_cleaning_rules(spark):
    rows = [
        (1, None, "Product Related", "makeup", "positive", "3", "1", "1", "1"),       # dropped
        (2, "x", None, None, None, "bad", None, None, None),                          # fills, zeros
        (3, "y", "Product Related", "skincare", "neutral", "3", "-2", "0", "0"),      # SOE -1.5
    ]
    e = {r.row_id: r for r in _enriched(spark, rows).collect()}
    assert set(e) == {2, 3}
    assert e[2].Predicted_Category == "[Not Applicable]" and e[2].predicted_sentiment == "others"
    assert e[2].likeCount_comment == 0.0 and e[2].comment_share_of_engagement == 0.0
    assert e[3].comment_share_of_engagement == -1.5


def test_missing_numeric_columns_added(spark):
    df = spark.createDataFrame([(1, "t", "Product Related", "makeup", "positive", "4")],
                               "row_id long, textOriginal string, isProductRelated string, "
                               "Predicted_Category string, predicted_sentiment string, likeCount_comment string")
    r = clean(df).first()
    assert (r.likeCount_video, r.favouriteCount, r.commentCount, r.comment_share_of_engagement) == (0.0, 0.0, 0.0, 0.0)


def test_not_applicable_kept_or_dropped(spark):
    rows = [(1, "a", "Product Related", None, "positive", "1", "10", "0", "0"),
            (2, "b", "Product Related", "makeup", "negative", "2", "10", "0", "0"),
            (3, "c", None, "makeup", "positive", "2", "10", "0", "0")]
    e = _enriched(spark, rows)
    assert {r.Predicted_Category for r in A.category_volume(e).collect()} == {"makeup"}
    assert {r.Predicted_Category for r in A.mean_soe_by_category(e).collect()} == {"makeup", "[Not Applicable]"}
    assert {r.Predicted_Category for r in A.sentiment_by_category(e).collect()} == {"makeup", "[Not Applicable]"}
    assert [r.Predicted_Category for r in A.category_options(e).collect()] == ["makeup"]
    rel = {r.isProductRelated: r["count"] for r in A.relevance_ratio(e).collect()}
    assert rel == {"Product Related": 2}
    assert A.product_comments(e.filter(F.lit(False))).isEmpty()


def test_soe_scenarios_edge_cases(spark):
    rows = [(1, "a", "Product Related", "makeup", "positive", "10", "100", "0", "0"),
            (2, "b", "Product Related", "skincare", "positive", "0", "0", "0", "0")]
    e = _enriched(spark, rows)
    scen = spark.createDataFrame(
        [("s1", "None", 5, 50, 0, 0), ("s2", "unknown", None, None, None, None),
         ("s3", "makeup", None, None, None, None), ("s4", "makeup", 20, None, None, None),
         ("s5", "skincare", 1, 1, 0, 0), ("s6", "makeup", -1, 1, 1, 1)],
        "scenario_id string, category string, proj_comment_likes long, proj_video_likes long, "
        "proj_video_favs long, proj_video_comments long")
    out = {r.scenario_id: r for r in soe_scenarios(e, scen).collect()}
    assert out["s1"].current_soe == 0.0 and out["s1"].projected_soe == 0.1 and out["s1"].relative_delta is None
    assert out["s2"].projected_soe == 0.0 and out["s2"].current_comment_likes == 0
    assert out["s3"].delta_soe == 0.0 and out["s3"].relative_delta == 0.0
    assert out["s4"].projected_soe == 0.2 and out["s4"].relative_delta == 1.0
    assert out["s5"].current_soe == 0.0 and out["s5"].relative_delta is None
    assert out["s6"].valid is False and out["s6"].projected_soe is None


def test_raw_tables_with_clashing_names(spark):
    from plume.operators.joins import integrate_raw

    c = spark.createDataFrame([(1, "v1", 5, "x"), (2, "v2", 6, "y"), (3, None, 7, "z")], "id long, videoId string, likeCount long, Title string")
    v = spark.createDataFrame([("v1", 100, "t")], "videoId string, likeCount long, title string")
    out = integrate_raw(c, v)
    assert out.columns == ["videoId", "id", "likeCount_comment", "Title_comment", "likeCount_video", "title_video"]
    assert sorted((r.id, r.likeCount_comment, r.likeCount_video) for r in out.collect()) == [(1, 5, 100), (2, 6, None), (3, 7, None)]
    with pytest.raises(ValueError, match="twice"):
        integrate_raw(c.withColumn("likeCount_video", c.id), v)
    with pytest.raises(ValueError, match="needs the column"):
        integrate_raw(c.drop("videoId"), v)


def test_encoding_needs_no_exchange(spark):
    from plume.operators import training as T

    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "c " * 300)], "row_id long, text string")
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "term string, id int")
    enc = T.encode_tokens(df, vocab, max_length=8)
    rows = {r.row_id: (r.input_ids, sum(r.attention_mask)) for r in enc.collect()}
    assert rows == {1: ([2, 5, 4, 5, 3, 0, 0, 0], 5), 2: ([2, 3, 0, 0, 0, 0, 0, 0], 2), 3: ([2, 3, 0, 0, 0, 0, 0, 0], 2),
                    4: ([2, 1, 1, 1, 1, 1, 1, 3], 8)}
    plan = enc._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
