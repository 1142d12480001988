"""Exact per-group first-n selection against the brute-force window form,
with a skewed group (a third of the rows and more)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plume.operators.sampling import seeded_hash, select_first_n
from plume.operators.training import balance_classes, stratified_split


def _data(spark):
    # label 0 holds ~60% of the rows (hot group), label 2 only 3 rows
    df = spark.range(3000).select(F.col("id").alias("row_id"),
                                  F.when(F.col("id") >= 2997, 2).when(F.col("id") % 5 < 3, 0).otherwise(1).alias("label"))
    return df


def test_split_equals_row_number_form(spark):
    df = _data(spark)
    got = {r.row_id for r in stratified_split(df, "label").filter("split = 'test'").collect()}
    w = Window.partitionBy("label").orderBy(seeded_hash(42, "row_id"), "row_id")
    ref = (df.withColumn("rn", F.row_number().over(w))
           .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label")))
           .filter(F.col("rn") <= F.ceil(F.col("n") * 0.2)))
    assert got == {r.row_id for r in ref.collect()}


def test_balance_equal_counts(spark):
    df = _data(spark)
    counts = {r.label: r["count"] for r in balance_classes(df, "label").groupBy("label").count().collect()}
    assert counts == {0: 3, 1: 3, 2: 3}


def test_need_larger_than_group_takes_all(spark):
    df = _data(spark).withColumn("_h", seeded_hash(7, "row_id"))
    out = select_first_n(df, "label", "_h", "row_id",
                         lambda sizes: sizes.withColumn("need", F.col("size") + 10))
    assert out.count() == 3000
    none = select_first_n(df, "label", "_h", "row_id", lambda sizes: sizes.withColumn("need", F.lit(0)))
    assert none.count() == 0


def test_null_label_is_a_class_of_its_own(spark):
    df = spark.range(60).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(1).alias("label"))
    split = {(r.label, r.split): r["count"] for r in stratified_split(df, "label").groupBy("label", "split").count().collect()}
    assert split == {(None, "test"): 4, (None, "train"): 16, (1, "test"): 8, (1, "train"): 32}
    counts = {r.label: r["count"] for r in balance_classes(df, "label").groupBy("label").count().collect()}
    assert counts == {None: 20, 1: 20}
