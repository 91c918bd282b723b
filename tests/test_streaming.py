"""Streams: roll-up equals batch, late rows kept, restart and replay counted once."""

import os

from pyspark.sql import functions as F

from linkstream.operators.rollup import clicks_by_code, compact_rollup, hourly_rollup
from linkstream.session import scratch_path
from linkstream.sources import fixtures as FX
from linkstream.sources.streams import read_clicks_stream
from linkstream.sources.tables import Tables
from linkstream.streaming import alerts as AL
from linkstream.streaming import ingest as IN
from tests.conftest import SF001

SCHEMA = "event_id long, value string"


def _write_msgs(spark, df, path, n_files):
    df.repartition(n_files).write.mode("overwrite").json(path)


def _total(spark, path):
    return IN.read_rollup(spark, path).agg(F.sum("total_clicks")).first()[0]


def test_rollup_stream_equals_batch_and_keeps_late_rows(spark):
    t = Tables(spark, SF001)
    msgs = FX.click_json(t)
    src = scratch_path(spark, "msgs")
    # shuffled files: later files hold earlier event times (late data)
    _write_msgs(spark, msgs.orderBy(F.rand(3)), src, 5)
    out, ck = scratch_path(spark, "roll"), scratch_path(spark, "ck")
    q = IN.stream_hourly_rollup(read_clicks_stream(spark, {"format": "json", "path": src, "schema": SCHEMA,
                                                           "max_files_per_trigger": 1}),
                                out, ck, {"availableNow": True})
    q.awaitTermination()
    from linkstream.operators.clicks import parse_clicks
    good, _ = parse_clicks(msgs)
    batch = hourly_rollup(good)
    streamed = compact_rollup(IN.read_rollup(spark, out))
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    # compaction keeps totals
    IN.compact_rollup_job(spark, out, q.lastProgress["batchId"] - 1)
    assert _total(spark, out) == good.count()
    assert clicks_by_code(IN.read_rollup(spark, out)).exceptAll(clicks_by_code(batch)).count() == 0


def test_restart_and_replay_are_idempotent(spark):
    t = Tables(spark, SF001)
    msgs = FX.click_json(t)
    from linkstream.operators.clicks import parse_clicks
    n_good = parse_clicks(msgs)[0].count()
    src = scratch_path(spark, "msgs2")
    a, b = msgs.randomSplit([0.5, 0.5], seed=1)
    a.write.json(os.path.join(src, "part-a"))
    out, ck = scratch_path(spark, "roll2"), scratch_path(spark, "ck2")
    cfg = {"format": "json", "path": src + "/*", "schema": SCHEMA}
    q = IN.stream_hourly_rollup(read_clicks_stream(spark, cfg), out, ck, {"availableNow": True})
    q.awaitTermination()
    first = _total(spark, out)
    b.write.json(os.path.join(src, "part-b"))
    q = IN.stream_hourly_rollup(read_clicks_stream(spark, cfg), out, ck, {"availableNow": True})
    q.awaitTermination()
    assert _total(spark, out) == n_good and first < n_good
    # A replayed batch (crash after the write, before the commit) runs the
    # writer again with the same batch id: it must replace, not add.
    from linkstream.sources.sinks import write_rollup
    last = q.lastProgress["batchId"]
    write_rollup(f"{out}/partials")(parse_clicks(b)[0], last)
    assert _total(spark, out) == n_good


def test_windowed_alert_stream_reports_late_drops(spark):
    t = Tables(spark, SF001)
    clicks = FX.clicks(t)
    src = scratch_path(spark, "rows")
    clicks.orderBy(F.rand(5)).repartition(4).write.parquet(src)
    stream = spark.readStream.schema(clicks.schema).option("maxFilesPerTrigger", 1).parquet(src)
    counts = AL.stream_bot_windowed(stream, "short_code", threshold=0, window="1 hour")
    q = (counts.writeStream.format("memory").queryName("late_alerts").outputMode("append")
               .option("checkpointLocation", scratch_path(spark, "ck3")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert AL.dropped_by_watermark(q) > 0  # shuffled files => late rows are counted, not hidden


def test_incremental_compaction_keeps_untouched_days(spark):
    from linkstream.operators.clicks import parse_clicks
    from linkstream.sources.sinks import write_rollup
    t = Tables(spark, SF001)
    good, _ = parse_clicks(FX.click_json(t))
    out = scratch_path(spark, "roll-inc")
    IN.init_rollup(spark, out)
    early = good.where(F.col("event_time") < F.lit("2024-01-15").cast("timestamp"))
    late = good.where(F.col("event_time") >= F.lit("2024-01-15").cast("timestamp"))
    w = write_rollup(f"{out}/partials")
    w(good, 0)
    IN.compact_rollup_job(spark, out, 0)           # every day in version 0
    w(late, 1)
    IN.compact_rollup_job(spark, out, 1)           # version 1 holds late days only
    IN.compact_rollup_job(spark, out, 1)           # re-run (replayed batch): no-op
    w(early.limit(5), 2)                            # not yet compacted
    versions = spark.read.parquet(f"{out}/compacted").where("upto = 1")
    assert versions.where(F.col("day") < F.lit("2024-01-15").cast("date")).count() == 0
    want = good.count() + late.count() + 5
    assert IN.read_rollup(spark, out).agg(F.sum("total_clicks")).first()[0] == want


def test_compaction_that_died_between_days_loses_nothing(spark):
    from linkstream.operators.clicks import parse_clicks
    from linkstream.sources.sinks import write_rollup
    good, _ = parse_clicks(FX.click_json(Tables(spark, SF001)))
    out = scratch_path(spark, "roll-crash")
    IN.init_rollup(spark, out)
    write_rollup(f"{out}/partials")(good, 0)
    total = good.count()
    day = good.select(F.to_date("event_time").alias("d")).agg(F.min("d")).first()[0]
    half = spark.read.parquet(f"{out}/partials").where((F.col("batch_id") == 0) & (F.to_date("hour") == F.lit(day)))
    half.drop("batch_id").write.parquet(f"{out}/compacted/upto=0/day={day}")  # the other days were never written
    assert IN.read_rollup(spark, out).agg(F.sum("total_clicks")).first()[0] == total
    IN.compact_rollup_job(spark, out, 0)
    assert IN.read_rollup(spark, out).agg(F.sum("total_clicks")).first()[0] == total
    assert IN._versions(spark, out)[1].agg(F.sum("total_clicks")).first()[0] == total
