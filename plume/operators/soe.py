"""Share of Engagement: per category, and what-if scenarios in bulk.

The calculator answers one scenario at a time for one chosen category.  Here
a whole table of scenarios is evaluated in one job: per-category baselines
(an aggregate with one row per category) are joined to the scenarios; a
scenario without a category, or with an unknown one, gets a zero baseline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import percent, ratio_positive, thousands
from .aggregates import category_totals

CURRENT = ["current_comment_likes", "current_video_likes", "current_video_favs", "current_video_comments"]
PROJECTED = ["proj_comment_likes", "proj_video_likes", "proj_video_favs", "proj_video_comments"]


def category_soe(df: DataFrame) -> DataFrame:
    """Aggregate SOE per category = sum likes / sum engagement (0 unless > 0)."""
    t = category_totals(df)
    den = F.col("current_video_likes") + F.col("current_video_favs") + F.col("current_video_comments")
    return t.select("Predicted_Category", *CURRENT,
                    den.alias("current_engagement"),
                    ratio_positive(F.col("current_comment_likes").cast("double"),
                                   den.cast("double")).alias("current_soe"))


def soe_scenarios(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Evaluate scenarios (scenario_id, category, proj_* nullable).

    A null projected input takes the current value; negative inputs are
    rejected (``valid`` = false, SOE columns null) as the input widget would;
    relative delta is null unless the current SOE > 0.
    """
    # Both sides are per-category / per-scenario aggregates (a few rows):
    # the join is cheap in any form, so no hint is given.
    base = category_totals(df).withColumnRenamed("Predicted_Category", "category")
    s = scenarios.join(base, "category", "left")
    s = s.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in CURRENT})
    s = s.withColumns({p: F.coalesce(F.col(p).cast("long"), F.col(c)) for p, c in zip(PROJECTED, CURRENT)})
    valid = F.lit(True)
    for p in PROJECTED:
        valid = valid & (F.col(p) >= 0)
    cur_den = F.col("current_video_likes") + F.col("current_video_favs") + F.col("current_video_comments")
    proj_den = F.col("proj_video_likes") + F.col("proj_video_favs") + F.col("proj_video_comments")
    s = s.withColumns({
        "valid": valid,
        "current_engagement": cur_den,
        "projected_engagement": proj_den,
        "current_soe": ratio_positive(F.col("current_comment_likes").cast("double"), cur_den.cast("double")),
        "projected_soe": ratio_positive(F.col("proj_comment_likes").cast("double"), proj_den.cast("double")),
    })
    s = s.withColumn("projected_soe", F.when(F.col("valid"), F.col("projected_soe")))
    s = s.withColumn("delta_soe", F.col("projected_soe") - F.col("current_soe"))
    s = s.withColumn("relative_delta",
                     F.when(F.col("current_soe") > 0, F.col("delta_soe") / F.col("current_soe")))
    return s.select(
        "scenario_id", "category", *CURRENT, *PROJECTED, "valid",
        "current_engagement", "projected_engagement",
        "current_soe", "projected_soe", "delta_soe", "relative_delta")


def soe_display(scored: DataFrame) -> DataFrame:
    """Presentation strings of the calculator (.4% SOE, .2% relative delta,
    thousands separators); 'N/A' when the relative delta is undefined."""
    return scored.select(
        "scenario_id", "category",
        percent(F.col("current_soe"), 4).alias("current_soe_text"),
        percent(F.col("projected_soe"), 4).alias("projected_soe_text"),
        F.when(F.col("relative_delta").isNull(), F.lit("N/A"))
        .otherwise(F.concat(percent(F.col("delta_soe"), 4), F.lit(" ("),
                            percent(F.col("relative_delta"), 2), F.lit(")"))).alias("delta_text"),
        thousands(F.col("current_comment_likes")).alias("current_likes_text"),
        thousands(F.col("current_engagement")).alias("current_engagement_text"))


def baseline_display(totals: DataFrame) -> DataFrame:
    """Presentation strings of the current values per category."""
    return totals.select("Predicted_Category",
                         percent(F.col("current_soe"), 4).alias("current_soe_text"),
                         thousands(F.col("current_comment_likes")).alias("current_likes_text"),
                         thousands(F.col("current_engagement")).alias("current_engagement_text"))


def derived_scenarios(df: DataFrame) -> DataFrame:
    """A scenario table derived from the data: for every category present
    among product-related rows, a set of planned changes (generated per row
    with ``explode``, no join), plus the 'None' baseline and an unknown
    category.  ``proj_*`` null means 'keep the current value'."""
    from ..functions.fixed_values import NOT_APPLICABLE

    plans = F.array(
        F.struct(F.lit(0).alias("plan"), *[F.lit(None).cast("double").alias(m) for m in ("m_likes", "m_vlikes", "m_favs", "m_comments")]),
        F.struct(F.lit(1).alias("plan"), F.lit(2.0).alias("m_likes"), F.lit(None).cast("double").alias("m_vlikes"),
                 F.lit(None).cast("double").alias("m_favs"), F.lit(None).cast("double").alias("m_comments")),
        F.struct(F.lit(2).alias("plan"), F.lit(1.0).alias("m_likes"), F.lit(1.5).alias("m_vlikes"),
                 F.lit(1.0).alias("m_favs"), F.lit(1.0).alias("m_comments")),
        F.struct(F.lit(3).alias("plan"), F.lit(0.0).alias("m_likes"), F.lit(0.0).alias("m_vlikes"),
                 F.lit(0.0).alias("m_favs"), F.lit(0.0).alias("m_comments")),
    )
    totals = (category_totals(df).withColumnRenamed("Predicted_Category", "category")
              .filter(F.col("category") != NOT_APPLICABLE))
    per_cat = totals.select("category", *CURRENT, F.explode(plans).alias("p"))
    proj = [F.floor(F.col(c) * F.col(f"p.{m}")).cast("long").alias(p)
            for c, m, p in zip(CURRENT, ("m_likes", "m_vlikes", "m_favs", "m_comments"), PROJECTED)]
    scen = per_cat.select("category", F.col("p.plan").alias("plan"), *proj)
    # Fixed edge cases beside the data-derived ones: no category chosen, an
    # unknown category, and a rejected (negative) input.
    extra = df.sparkSession.createDataFrame(
        [("None", 10, 500, 1000, 100, 50), ("unknown category", 11, None, None, None, None),
         ("None", 12, -1, 10, 10, 10)],
        "category string, plan int, " + ", ".join(f"{p} long" for p in PROJECTED))
    out = scen.unionByName(extra)
    return out.select(F.concat_ws("#", "category", F.col("plan").cast("string")).alias("scenario_id"),
                      "category", *PROJECTED)
