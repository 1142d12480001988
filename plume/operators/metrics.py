"""Classification metrics as aggregates.

Everything starts from one confusion table ``groupBy(label, prediction)``
(partial aggregation: the data is reduced inside each task to at most
classes^2 rows), then works on that tiny table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir



def _div(num, den):
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return (df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   positive=1) -> DataFrame:
    """accuracy, precision, recall, f1 of the positive class (0 when
    undefined), plus the confusion counts."""
    y, p = F.col(label), F.col(prediction)
    m = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == positive) & (p == positive)).alias("tp"),
        F.count_if((y != positive) & (p == positive)).alias("fp"),
        F.count_if((y == positive) & (p != positive)).alias("fn"),
        F.count_if(y == p).alias("correct"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return m.select(
        "n", "tp", "fp", "fn",
        _div(F.col("correct"), F.col("n")).alias("accuracy"),
        _div(tp, tp + fp).alias("precision"),
        _div(tp, tp + fn).alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(cls, support, predicted, tp, precision, recall, f1) over the union of
    true and predicted classes (a class seen only in predictions has
    support 0)."""
    # read three times below, a row per pair of classes
    c = confusion(df, label, prediction)
    ensure_checkpoint_dir(df.sparkSession)
    c = c.checkpoint(eager=True)
    support = c.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    predicted = c.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = c.filter(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("n").alias("tp"))
    stats = (support.join(predicted, "cls", "full").join(tp, "cls", "left")
             .na.fill(0, subset=["support", "predicted", "tp"]))
    return stats.select(
        "cls", "support", "predicted", "tp",
        _div(F.col("tp"), F.col("predicted")).alias("precision"),
        _div(F.col("tp"), F.col("support")).alias("recall"),
        _div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Support-weighted precision / recall / f1 and accuracy."""
    pc = per_class(df, label, prediction)
    w = F.col("support").cast("double")
    return pc.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(w * F.col("precision")) / F.sum(w)).alias("precision"),
        (F.sum(w * F.col("recall")) / F.sum(w)).alias("recall"),
        (F.sum(w * F.col("f1")) / F.sum(w)).alias("f1"),
        F.sum("support").alias("n"))
