"""Exact, repeatable per-group selection of the first ``n`` rows by a hash
order: the building block of class balancing and the stratified split.

The obvious plan, ``row_number() over (partition by label order by hash)``,
sends every row of a class to one task: with two classes that is half of
the data in one task.  Instead we find, per group, the exact key of the
``n``-th row with two levels of hash-prefix histograms:

1. count rows per (group, first 4 hex digits)            -> <= 65,536 rows/group
2. in the bucket where the running count reaches ``n``, count rows per
   (group, next 4 hex digits)                            -> <= 65,536 rows/group
3. rank only the rows of the level-2 boundary bucket (about 1 / 2^32 of the
   group) to get the exact threshold key.

A row is selected iff ``(hash, tie) <= threshold(group)``.  Thresholds are
one row per group (their number is counted before they are broadcast), so
selecting is a broadcast join + filter on the original rows: the wide rows
are never shuffled.  Every aggregate is partial-then-final, so a group
holding a third of all rows is fine.  The result equals the row_number form
(checked against SQL).  The narrow key columns are checkpointed once to the
shared checkpoint folder, so the histogram passes do not recompute the
upstream plan and survive executor loss.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Groups up to which the per-group tables (a row each) are broadcast; counted
# for every call.
MAX_GROUPS = 100_000
_PREFIX = 4  # hex digits per histogram level (65,536 buckets)
_TOP = "g" * 32  # sorts after any lowercase hex digest


def seeded_hash(seed: int | str, key: str) -> F.Column:
    """md5 of '<seed>:<key>' as 32 lowercase hex digits (portable to SQL)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _boundary(hist: DataFrame, group: str, bucket: str, need: str) -> DataFrame:
    """Per group: the bucket where the running count reaches ``need`` and how
    many rows are still needed inside it.  The window runs over a histogram
    (at most 65,536 rows per group), never over data rows."""
    w = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.withColumn("_through", F.sum("count").over(w))
    h = h.withColumn("_before", F.col("_through") - F.col("count"))
    crossing = h.filter((F.col("_before") < F.col(need)) & (F.col("_through") >= F.col(need)))
    return crossing.select(group, F.col(bucket).alias("_b"), (F.col(need) - F.col("_before")).alias("_need"))


def select_first_n(df: DataFrame, group: str, hash_col: str, tie: str,
                   need_from_sizes: Callable[[DataFrame], DataFrame],
                   flag: str | None = None) -> DataFrame:
    """Rows whose (hash, tie) is among the first ``need`` rows of their group.

    ``need_from_sizes`` maps a (group, size) table to (group, need).  With
    ``flag`` set all rows are kept and the boolean ``flag`` tells membership
    (a split); otherwise non-members are dropped (a sample).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # null is a group like any other: joins go by a name that is never null
    given, group = group, "_group"
    df = df.withColumn(group, F.when(F.col(given).isNull(), F.lit("null")).otherwise(
        F.concat(F.lit("="), F.col(given).cast("string"))))
    keys = df.select(group, hash_col, tie).checkpoint(eager=True)

    sizes = keys.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    n_groups = sizes.count()  # one row per group, read from the checkpointed keys
    need = (need_from_sizes(sizes).select(group, F.col("need").cast("long").alias("need"))
            .join(sizes, group))
    per_group = F.broadcast if n_groups <= MAX_GROUPS else (lambda d: d)
    active = need.filter(F.col("need") > 0)

    b1 = F.substring(hash_col, 1, _PREFIX)
    hist1 = (keys.groupBy(group, b1.alias("_b1")).agg(F.count(F.lit(1)).alias("count"))
             .join(per_group(active.select(group, "need")), group))
    bound1 = _boundary(hist1, group, "_b1", "need")
    cand1 = (keys.join(per_group(bound1), group).filter(b1 == F.col("_b"))
             .select(group, hash_col, tie, F.col("_need").alias("need1")))

    b2 = F.substring(hash_col, _PREFIX + 1, _PREFIX)
    hist2 = cand1.groupBy(group, b2.alias("_b2"), "need1").agg(F.count(F.lit(1)).alias("count"))
    bound2 = _boundary(hist2, group, "_b2", "need1")
    cand2 = cand1.join(per_group(bound2), group).filter(b2 == F.col("_b"))

    w = Window.partitionBy(group).orderBy(hash_col, tie)
    exact = (cand2.withColumn("_rn", F.row_number().over(w))
             .filter(F.col("_rn") == F.col("_need"))
             .select(group, F.col(hash_col).alias("_t_hash"), F.col(tie).alias("_t_tie")))
    take_all = active.filter(F.col("need") > F.col("size")).select(
        group, F.lit(_TOP).alias("_t_hash"), F.lit(None).cast(keys.schema[tie].dataType).alias("_t_tie"))
    thresholds = exact.unionByName(take_all)

    j = df.join(per_group(thresholds), group, "left")
    inside = F.coalesce(
        (F.col(hash_col) < F.col("_t_hash"))
        | ((F.col(hash_col) == F.col("_t_hash"))
           & (F.col("_t_tie").isNull() | (F.col(tie) <= F.col("_t_tie")))),
        F.lit(False))
    if flag:
        return j.withColumn(flag, inside).drop("_t_hash", "_t_tie", group)
    return j.filter(inside).drop("_t_hash", "_t_tie", group)
