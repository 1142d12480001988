"""Spark ML operators: the winner is used, held-out quality, the gate."""

import pytest

from plume.operators import ml
from plume.plans import catalog

from conftest import SF001


@pytest.fixture(scope="module")
def category(spark):
    return ml.category_data(spark, SF001).checkpoint(eager=True)


def test_best_candidate_is_fitted_and_beats_the_largest_class(spark, category):
    train, test = category.filter("split = 'train'"), category.filter("split = 'test'")
    model, tried = ml.fit_best(train)
    best = max(tried, key=lambda r: (r[1], r[0]))[0]
    assert model.stages[-1].getOrDefault("regParam") == best
    rows = ml.predictions(model, test).collect()
    assert len(rows) == test.count()
    largest = max(r["count"] for r in test.groupBy("label").count().collect()) / len(rows)
    assert sum(r.label == r.prediction for r in rows) / len(rows) > largest
    assert all(0 < r.confidence <= 1 for r in rows)


def test_gate_keeps_every_row_and_shuffles_no_text(spark):
    df = catalog.queries()["gated_ml"](spark, SF001)
    rows = df.collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.is_related in ("Yes", "No") and 0 < r.relevance_score <= 1
        assert (r.category is None) == (r.sentiment is None) == (r.is_related == "No")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_validation_rows_have_no_say_in_the_tuned_features(spark, category):
    from pyspark.sql import functions as F

    rows = ml.validation_split(category.filter("split = 'train'")).checkpoint(eager=True)
    fitted, _ = ml.tuning_features(rows)
    others = rows.withColumn("text", F.when(F.col("split") == "test", F.lit("entirely other words")).otherwise(F.col("text")))
    again, _ = ml.tuning_features(others)
    assert fitted.stages[-1].idf == again.stages[-1].idf
    assert fitted.stages[-1].numDocs == rows.filter("split = 'train'").count() < rows.count()


def test_comments_are_scanned_and_tokenized_once_with_the_same_result(spark):
    from pyspark.sql import functions as F

    from plume.functions.text import normalize_text
    from plume.operators.labelling import weak_labels
    from plume.sources import fixtures as FX

    rows = ml.prepared(spark, SF001)
    twice = weak_labels(FX.enriched(spark, SF001).withColumn("text", normalize_text("textOriginal")), "text", "category") \
        .select("row_id", "text", (F.col("isProductRelated") == "Product Related").cast("int").alias("isProductRelated"),
                "predicted_sentiment", "category")
    assert sorted(map(str, rows.drop("tf").collect())) == sorted(map(str, twice.collect()))
    counted = ml.with_terms(rows.drop("tf"))
    assert sorted(map(str, rows.select("row_id", "tf").collect())) == sorted(map(str, counted.select("row_id", "tf").collect()))
    plan = ml.predictions(ml.fit_best(ml.category_data(spark, SF001, rows))[0], rows.withColumn("label", F.lit(0)))
    assert "tokens" not in plan._jdf.queryExecution().analyzed().toString()
