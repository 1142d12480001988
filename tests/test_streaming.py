"""Streams equal the batch result over the same rows; late rows are dropped."""

import os
import shutil

from pyspark.sql import functions as F

from plume.session import local_fs_path, scratch_path
from plume.streaming.enrich import run_enrich_stream
from plume.streaming.trend import latest_windows, trend_counts
from plume.sources import fixtures as FX
from plume.operators.labelling import analyze_comments

from conftest import SF0001


def test_trend_stream_equals_batch(spark):
    from plume.streaming.trend import run_trend_stream
    got = run_trend_stream(spark, SF0001)
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    ref = ev.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count()
    assert got.count() == ref.count()
    assert got.agg(F.sum("count")).first()[0] == ev.count()


def test_enrich_stream_equals_batch(spark):
    got = run_enrich_stream(spark, SF0001)
    ref = analyze_comments(FX.comments(spark, SF0001))
    cols = ["row_id", "is_related", "category", "brands"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, ref.select(cols).collect()))


def test_trend_watermark_drops_late_rows(spark):
    base = local_fs_path(scratch_path(spark, "late"))
    land = os.path.join(base, "landing")
    os.makedirs(land)
    schema = "event_id long, ts timestamp, event_type string"
    files = [[(1, "2024-01-01 10:00:00", "a"), (2, "2024-01-03 10:00:00", "a")],
             [(3, "2024-01-03 12:00:00", "a")],
             [(4, "2024-01-01 11:00:00", "a")]]          # late: behind the watermark
    for i, rows in enumerate(files):
        tmp = os.path.join(base, f"f{i}")
        (spark.createDataFrame(rows, "event_id long, ts string, event_type string")
         .select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
         .coalesce(1).write.parquet(tmp))
        src = [f for f in os.listdir(tmp) if f.endswith(".parquet")][0]
        dst = os.path.join(land, f"events_{i}.parquet")
        shutil.copy(os.path.join(tmp, src), dst)
        os.utime(dst, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))  # arrival order
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
              .option("maxFilesPerTrigger", 1).parquet(land))
    out = os.path.join(base, "out")

    def write_batch(batch, batch_id):
        (batch.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                      "event_type", "count").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"))

    q = (trend_counts(stream, "1 day", "1 hour").writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    counts = {str(r.window_start.date()): r["count"] for r in latest_windows(spark, out).collect()}
    # Spark filters late input with the previous batch's watermark: the Jan 1
    # row of the third file is behind it (Jan 3 09:00) and is dropped
    assert counts == {"2024-01-01": 1, "2024-01-03": 2}


def test_trend_stream_independent_of_session_time_zone(spark):
    from plume.streaming.trend import run_trend_stream
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    ref = {(r.d, r.event_type): r.n for r in ev.groupBy(F.to_date("ts").alias("d"), "event_type")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = {(r.window_start.date(), r.event_type): r["count"] for r in run_trend_stream(spark, SF0001).collect()}
        starts = {r.window_start.time() for r in run_trend_stream(spark, SF0001).select("window_start").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == ref
    assert starts == {__import__("datetime").time(0, 0)}


def test_enrich_stream_restart_is_exactly_once(spark):
    out = scratch_path(spark, "restart")
    first = run_enrich_stream(spark, SF0001, out=out).count()
    again = run_enrich_stream(spark, SF0001, out=out).count()   # same checkpoint: nothing new
    assert first == again == FX.comments(spark, SF0001).na.drop(subset=["textOriginal"]).count()


def test_streams_start_on_an_empty_landing_folder(spark):
    from plume.streaming.enrich import document_stream, enrich_stream
    from plume.streaming.trend import event_stream
    land = local_fs_path(scratch_path(spark, "empty-landing"))
    os.makedirs(land)
    assert enrich_stream(document_stream(spark, land)).columns[0] == "row_id"
    assert trend_counts(event_stream(spark, land)).columns == ["window", "event_type", "count"]


def test_streams_read_tables_that_are_folders_of_files(spark):
    from plume.streaming.trend import run_trend_stream
    land = local_fs_path(scratch_path(spark, "folder-landing"))
    docs = spark.createDataFrame([(i, f"text {i} serum", "en", "src1", 10) for i in range(6)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{land}/documents.parquet")
    spark.createDataFrame([(i, "a") for i in range(6)], "event_id long, event_type string") \
         .select("event_id", F.expr("timestamp_ntz'2024-01-01 10:00:00'").alias("ts"), "event_type") \
         .repartition(3).write.parquet(f"{land}/events.parquet")
    got = run_enrich_stream(spark, land)
    ref = analyze_comments(FX.comments_from(docs))
    assert sorted(map(str, got.collect())) == sorted(map(str, ref.collect()))
    assert [(r.event_type, r["count"]) for r in run_trend_stream(spark, land).collect()] == [("a", 6)]


def test_enrich_stream_of_an_empty_landing_folder_has_no_rows(spark):
    land = local_fs_path(scratch_path(spark, "nothing-landed"))
    os.makedirs(land)
    got = run_enrich_stream(spark, land)
    assert got.count() == 0 and got.columns[:2] == ["row_id", "comment"]
