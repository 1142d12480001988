"""Plan shape guards: one regex pass per row, joins by size,
pruned scans over a materialized enriched table."""

from pyspark.sql import functions as F

from plume.operators.aggregates import sentiment_overview
from plume.operators.joins import integrate_videos
from plume.plans import catalog
from plume.plans.dashboard import materialize_enriched

from conftest import SF0001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_regex_runs_once_under_filters(spark):
    plan = _plan(catalog.queries()["category_volume"](spark, SF0001))
    assert plan.count("regexp_extract_all") == 1


def test_materialized_table_prunes_text(spark):
    path = materialize_enriched(spark, SF0001)
    e = spark.read.parquet(path)
    plan = _plan(sentiment_overview(e))
    assert "textOriginal" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert sentiment_overview(e).agg(F.sum("count")).first()[0] == e.count()


def test_spread_is_noop_for_wide_scans(spark):
    from plume.sources.tables import spread
    wide = spark.range(0, 1000, 1, numPartitions=spark.sparkContext.defaultParallelism * 2)
    assert "Exchange" not in _plan(spread(wide, "id"))
    narrow = spark.range(0, 1000, 1, numPartitions=1)
    assert spread(narrow, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_join_strategy_follows_the_size_of_the_table(spark, scratch):
    """The same path, small and then large: nothing is remembered."""
    facts = spark.range(0, 1000, 1).select((F.col("id") % 50).cast("string").alias("videoId"))
    for rows, small in ((5, True), (200_000, False)):
        spark.range(rows).select(F.col("id").cast("string").alias("videoId"), F.rand(1).alias("x")) \
             .write.mode("overwrite").parquet(scratch)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
        try:
            joined = integrate_videos(facts, spark.read.parquet(scratch))
            assert ("BroadcastHashJoin" in joined._jdf.queryExecution().sparkPlan().toString()) == small
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_gated_pipeline_reads_the_text_once_and_does_not_shuffle_it(spark):
    plan = _plan(catalog.queries()["gated_pipeline"](spark, SF0001))
    assert plan.count("regexp_extract_all") == 1
    for line in plan.split("\n"):
        assert not ("Exchange hashpartitioning" in line and "textOriginal" in line)
