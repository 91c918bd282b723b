"""Empty inputs, malformed messages, offsets, and properties."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkstream.functions import codes as K
from linkstream.operators import clicks as C
from linkstream.operators import links as L
from linkstream.operators import resolve as RS
from linkstream.operators import rollup as R
from linkstream.operators import toplinks as TL
from linkstream.sources import fixtures as FX
from linkstream.sources.tables import Tables
from tests.conftest import SF001

CLICKS = "event_time timestamp, short_code string, country_code string, user_agent string"
LINKS = "id string, long_url string, user_id string, created_at timestamp"
MUTS = "id string, op string, long_url string, user_id string, commit_ts timestamp, seq long"


def test_empty_inputs(spark):
    clicks = spark.createDataFrame([], CLICKS)
    links = spark.createDataFrame([], LINKS)
    roll = R.hourly_rollup(clicks)
    assert roll.count() == 0
    top = TL.top_links_enriched(roll, links)
    assert top.count() == 0
    assert TL.top_links_json(top).first().json == '{"top_links":[]}'
    final, app, rej = L.apply_mutations(None, spark.createDataFrame([], MUTS))
    assert (final.count(), app.count(), rej.count()) == (0, 0, 0)
    reqs = spark.createDataFrame([], "request_id long, ts timestamp, short_code string")
    known = spark.createDataFrame([], "value string")
    assert RS.resolve_redirects(reqs, RS.known_codes(known), None, links).count() == 0


def test_malformed_and_offset_messages(spark):
    rows = [(1, '{"short_code":"abc","timestamp":"2026-03-14T14:14:54Z","country":"DE","user_agent":"x"}'),
            (2, '{"short_code":"abc","timestamp":"2026-03-14T20:00:00+05:30","country":"","user_agent":"x"}'),
            (3, '{"short_code":"abc","timestamp":"2026-03-14T14:14:54.250Z","country":"FR","user_agent":"x"}'),
            (4, '{oops'), (5, '{"short_code":"","timestamp":"2026-03-14T14:14:54Z"}'),
            (6, '{"short_code":"abc","timestamp":"yesterday"}'), (7, '{"short_code":"abc"}'), (8, None)]
    df = spark.createDataFrame(rows, "event_id long, value string")
    good, bad = C.parse_clicks(df)
    g = {r.event_id: r for r in good.collect()}
    assert set(g) == {1, 2, 3}
    assert g[1].event_time == dt.datetime(2026, 3, 14, 14, 14, 54)
    assert g[2].event_time == dt.datetime(2026, 3, 14, 14, 30, 0)      # +05:30 normalised to UTC
    assert g[2].country_code == "Unknown"                               # empty header -> default
    assert g[3].event_time == dt.datetime(2026, 3, 14, 14, 14, 54, 250000)
    reasons = {r.event_id: r.reject_reason for r in bad.collect()}
    assert reasons == {4: "malformed_json", 5: "missing_short_code", 6: "bad_timestamp",
                       7: "missing_timestamp", 8: "malformed_json"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=(1 << 64) - 1), min_size=1, max_size=200))
def test_base62_roundtrip_property(spark, values):
    df = spark.createDataFrame([(str(v),) for v in values], "v string").select(F.col("v").cast("decimal(20,0)").alias("v"))
    h = K.halves_from_decimal("v")
    coded = df.select("v", K.base62_encode(h["hi"], h["lo"]).alias("c"))
    d = K.base62_decode("c")
    back = coded.select(F.col("v").cast("string").alias("v"), "c",
                        K.halves_to_decimal(d["hi"], d["lo"]).cast("string").alias("w"))
    for r in back.collect():
        assert r.v == r.w and len(r.c) == 11


def test_rollup_properties(spark):
    t = Tables(spark, SF001)
    clicks = FX.clicks(t)
    roll = R.hourly_rollup(clicks)
    assert roll.agg(F.sum("total_clicks")).first()[0] == clicks.count()
    # compaction of split partials leaves per-code totals unchanged
    parts = (clicks.withColumn("b", F.col("event_id") % 3)
                   .groupBy("b", F.date_trunc("hour", "event_time").alias("hour"), "short_code", "country_code")
                   .agg(F.count(F.lit(1)).alias("total_clicks")))
    a = R.clicks_by_code(R.compact_rollup(parts))
    b = R.clicks_by_code(roll)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # every clicked code is either enriched (live link) or an orphan
    links = FX.url_mappings(t)
    totals = R.clicks_by_code(roll)
    live = totals.join(links.select(F.col("id").alias("short_code")), "short_code", "left_semi")
    orphans = TL.orphan_clicks(roll, links)
    assert live.count() + orphans.count() == totals.count()


def test_configured_limit_audit(spark):
    base = dt.datetime(2026, 3, 14, 12, 0, 0)
    rows = [(i, base + dt.timedelta(microseconds=i), "c") for i in range(1003)]   # 1003 in one second
    reqs = spark.createDataFrame(rows, "request_id long, ts timestamp, short_code string")
    over = RS.audit_configured_limit(reqs, "read_edge").collect()                     # 1000/s bucket
    assert [(r.requests, r.excess) for r in over] == [(1003, 3)]
    assert RS.audit_configured_limit(reqs, "read").count() == 0                     # 5000/s global


def test_stale_read_hides_recent_changes(spark):
    t0 = dt.datetime(2026, 3, 14, 12, 0, 0)
    log = spark.createDataFrame([("a", "insert", "u1", "x", t0, 1),
                                 ("a", "update", "u2", "x", t0 + dt.timedelta(seconds=10), 2)], MUTS)
    now = "2026-03-14 12:00:20"
    stale = L.stale_read(log, now, "15 seconds").collect()
    strong = L.stale_read(log, now, "0 seconds").collect()
    assert [r.long_url for r in stale] == ["u1"] and [r.long_url for r in strong] == ["u2"]


def test_rfc3339_fractions(spark):
    from linkstream.functions.timefns import rfc3339_to_ts
    want = {"2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02T03:04:05.1Z": "2024-01-02 03:04:05.1",
            "2024-01-02T03:04:05.123456Z": "2024-01-02 03:04:05.123456",
            "2024-01-02T03:04:05.123456789+05:30": "2024-01-01 21:34:05.123456",
            "2024-01-02T03:04:05.Z": None, "2024-01-02T03:04:05.1234567891Z": None, "2024-01-02T03:04:05.5": None}
    df = spark.createDataFrame([(x,) for x in want], "x string")
    assert {r["x"]: r["t"] for r in df.select("x", rfc3339_to_ts("x").cast("string").alias("t")).collect()} == want


def test_rolling_avg_below_one_second(spark):
    from linkstream.operators.patterns import rolling_avg
    df = spark.sql("select 1 k, timestamp'2024-01-01 00:00:10.1' ts, 1.0D v union all select 1, timestamp'2024-01-01 00:00:10.9', 9.0D")
    assert [r["rolling_avg"] for r in rolling_avg(df, "k", "ts", "v", 60).orderBy("ts").collect()] == [1.0, 5.0]


def test_cycle_walk_keeps_to_its_bound(spark):
    import pytest
    ids = spark.range(50).select(K.cycle_walk(F.lit(0), F.col("id")).alias("w"), K.feistel_obfuscate(F.lit(0), F.col("id")).alias("f"))
    assert ids.where("w <> f").count() == 0
    with pytest.raises(Exception, match="above its bound"):
        spark.range(50).select(K.cycle_walk(F.lit(0), F.col("id"), 1, 0)).collect()


def test_hourly_averages_come_in_order(spark):
    from linkstream.operators.patterns import hourly_avg
    hours = [r["hour"] for r in hourly_avg(FX.sensor_data(Tables(spark, SF001)), 3, FX.NOW, "720 HOURS").collect()]
    assert len(hours) > 1 and hours == sorted(hours)


def test_micro_batches_follow_the_configured_size(spark):
    from linkstream.session import scratch_path
    from linkstream.sources.streams import read_clicks_stream
    src = scratch_path(spark, "sized")
    FX.click_json(Tables(spark, SF001)).repartition(6).write.json(src)
    for size, batches in ((1, 6), (4, 2)):
        cfg = {"format": "json", "path": src, "schema": "event_id long, value string", "max_files_per_trigger": size}
        q = (read_clicks_stream(spark, cfg).writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "sized-ck"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        assert len([p for p in q.recentProgress if p["numInputRows"]]) == batches
