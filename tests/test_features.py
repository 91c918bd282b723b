"""As-of reads, span trees, mergeable sketches, hot-key joins, retention."""

import os
import random

import pytest
from pyspark.sql import functions as F

from linkstream.operators import resolve as RS
from linkstream.operators import rollup as R
from linkstream.operators import telemetry as TM
from linkstream.plans import ranking
from linkstream.session import scratch_path
from linkstream.sources import files, retention


# ---- hot keys ----

@pytest.fixture
def eager_skew(spark):
    """Spark splits what is little larger than the rest, and broadcasts nothing."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_code_is_split_in_redirects(spark, eager_skew):
    reqs = spark.range(40_000).select(F.col("id").alias("request_id"), F.timestamp_seconds("id").alias("ts"),
                                      F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("short_code"))
    codes = reqs.select("short_code").distinct()
    links = codes.select(F.col("short_code").alias("id"), F.concat(F.lit("https://x/"), "short_code").alias("long_url"))
    out = RS.resolve_redirects(reqs.repartition(8), codes, None, links)
    assert "skew=true" in final_plan(out) and out.where("status = 302").count() == 40_000


def test_hot_trace_is_split(spark, eager_skew):
    spans = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 300).alias("trace_id"), F.col("id").alias("span_id"),
                                       F.lit(None).cast("bigint").alias("parent_span_id"), F.lit("s").alias("service"),
                                       F.timestamp_seconds("id").alias("start_ts"), (F.col("id") % 100).alias("duration_ms")).repartition(8)
    logs = spans.select("trace_id", F.concat(F.lit("line "), "span_id").alias("line"))
    for out in (TM.logs_for_trace(logs, spans), TM.trace_waterfall(spans)):
        assert "skew=true" in final_plan(out) and out.count() == 20_000


# ---- as-of redirects ----

def test_as_of_against_a_walk_through_the_log(spark):
    rng = random.Random(4)
    codes = ["hot"] * 6 + ["a", "b", "never", "", None]
    changes = [(rng.choice(codes[:8]), rng.choice(["insert", "update", "delete"]), f"u{i}", rng.randrange(0, 400), i) for i in range(150)]
    created = [("hot", 30), ("a", 100), ("b", 0)]
    asked = [(i, rng.randrange(0, 420), rng.choice(codes)) for i in range(900)]
    ch = spark.createDataFrame(changes, "id string, op string, long_url string, t bigint, seq bigint").withColumn("commit_ts", F.timestamp_seconds("t"))
    cr = spark.createDataFrame(created, "value string, t bigint").withColumn("timestamp", F.timestamp_seconds("t"))
    rq = spark.createDataFrame(asked, "request_id int, t bigint, short_code string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for stale in (15, 0):
        got = {r["request_id"]: (r["source"], r["long_url"]) for r in
               RS.resolve_redirects_as_of(rq, cr, None, ch.drop("t"), f"{stale} SECONDS").collect()}
        for i, t, code in asked:
            if not code:
                want = ("missing_short_code", None)
            elif not any(c == code and at <= t for c, at in created):
                want = ("url_not_found_bloom", None)
            else:
                seen = max(((at, s, op, url) for c, op, url, at, s in changes if c == code and at + stale <= t), default=None)
                want = ("db_stale", seen[3]) if seen and seen[2] != "delete" else ("url_not_found_db", None)
            assert got[i] == want, (i, t, code)


# ---- span trees ----

def _spans(spark, rows):
    return spark.createDataFrame(rows, "trace_id bigint, span_id bigint, parent_span_id bigint, s double, duration_ms bigint") \
                .select("trace_id", "span_id", "parent_span_id", F.lit("x").alias("service"), F.timestamp_micros((F.col("s") * 1000).cast("bigint")).alias("start_ts"),
                        "duration_ms")


def test_chain_of_ten_thousand_spans_in_log_rounds(spark, monkeypatch):
    n, cuts = 10_000, []
    monkeypatch.setattr(TM, "stable", lambda df: cuts.append(1) or ranking.stable(df))
    rows = spark.range(n).select(F.lit(1).alias("trace_id"), F.col("id").alias("span_id"),
                                 F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_span_id"),
                                 F.timestamp_millis("id").alias("start_ts"), (2 * n - 2 * F.col("id")).alias("duration_ms"))
    got = TM._depths(rows)
    assert got.where("depth <> span_id or not on_path").count() == 0 and got.count() == n
    assert len(cuts) <= 16  # the first one and a round for each power of two


def test_tree_of_odd_traces(spark):
    rows = [(1, 1, None, 0.0, 100), (1, 2, 1, 10.0, 30), (1, 3, 1, 20.0, 30), (1, 4, 1, 90.0, 50), (1, 5, 3, 20.0, 5),  # overlapping, past the end
            (2, 1, 99, 0.0, 10), (2, 2, 1, 0.0, 10),  # parent not there
            (3, 1, 2, 0.0, 10), (3, 2, 1, 0.0, 10),  # a ring
            (4, 1, None, 0.0, 5), (4, 2, 1, 0.0, 5), (4, 3, 1, 0.0, 5)]  # ties
    got = {(r["trace_id"], r["span_id"]): (r["depth"], float(r["self_ms"]), r["on_critical_path"]) for r in TM.trace_tree(_spans(spark, rows)).collect()}
    assert got == {(1, 1): (0, 50.0, True), (1, 2): (1, 30.0, False), (1, 3): (1, 25.0, False), (1, 4): (1, 50.0, True), (1, 5): (2, 5.0, False),
                   (2, 1): (0, 0.0, True), (2, 2): (1, 10.0, True), (3, 1): (None, 0.0, False), (3, 2): (None, 0.0, False),
                   (4, 1): (0, 0.0, True), (4, 2): (1, 5.0, True), (4, 3): (1, 5.0, False)}


# ---- mergeable states ----

def test_stored_quantiles_are_near_exact_ranks(spark):
    points = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("service"),
                                         F.timestamp_seconds(F.col("id") / 4).alias("ts"), F.pow(F.rand(7), 3).alias("duration"),
                                         F.when(F.col("id") % 50 == 0, 500).otherwise(200).alias("status_code")).checkpoint()
    minutes = TM.red_partials(points)
    hours = TM.merge_red(minutes.repartition(5), "hour")
    got = {(r["service"], str(r["bucket"])): r for r in TM.red_from_partials(hours, "day").collect()}
    exact = {(r["service"], str(r["bucket"])): r for r in TM.service_red(points, "day").collect()}
    assert got.keys() == exact.keys()
    for k, r in got.items():
        assert r["requests"] == exact[k]["requests"] and r["error_rate"] == pytest.approx(exact[k]["error_rate"])
        for name, p in (("p50", .5), ("p90", .9), ("p99", .99)):  # duration = u^3, so a value's rank is its cube root
            assert abs(r[name] ** (1 / 3) - p) < 0.015
            assert abs(r[name] ** (1 / 3) - exact[k][name] ** (1 / 3)) < 0.01
    nothing = points.limit(3).withColumn("duration", F.lit(None).cast("double"))
    assert all(r["p50"] is None for r in TM.red_from_partials(TM.red_partials(nothing), "day").collect())


def test_unique_visitors_within_the_error_bound(spark):
    clicks = spark.range(200_000).select(F.timestamp_seconds(F.col("id") % 86400).alias("event_time"), F.lit("x").alias("short_code"),
                                         F.lit("C").alias("country_code"), (F.col("id") % 60_000).cast("string").alias("who"))
    parts = [R.hourly_rollup(c, visitor="who") for c in clicks.randomSplit([1.0] * 4, 3)]
    stored = R.compact_rollup(parts[0].unionByName(parts[1])).unionByName(parts[2]).unionByName(parts[3])
    day = R.unique_visitors(stored, "day", []).collect()
    assert len(day) == 1 and abs(day[0]["visitors"] - 60_000) < 0.05 * 60_000  # three deviations
    for r, want in zip(sorted(R.unique_visitors(stored, "hour").collect(), key=lambda r: r["period"]),
                       sorted(clicks.groupBy(F.date_trunc("hour", "event_time").alias("h")).agg(F.countDistinct("who").alias("n")).collect())):
        assert abs(r["visitors"] - want["n"]) < 0.05 * want["n"]
    none = R.hourly_rollup(clicks.limit(5)).withColumn("visitors", F.lit(None).cast("binary"))
    assert [r["visitors"] for r in R.unique_visitors(none).collect()] == [0]


# ---- retention ----

def _stamps(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_retention_leaves_kept_days_alone(spark):
    path = scratch_path(spark, "days").removeprefix("file:")
    rows = spark.range(0, 10 * 24).select("id", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("at"))
    retention.write_by_day(rows, path, "at")
    before = _stamps(path)
    changed = retention.drop_expired(spark, path, "at", "2024-01-10 12:00:00", "5 DAYS")  # cutoff 2024-01-05 12:00
    assert changed == [f"2024-01-0{d}" for d in range(1, 6)]
    left = spark.read.parquet(path)
    assert left.count() == 5 * 24 + 12 and left.agg(F.min("at")).first()[0].isoformat() == "2024-01-05T12:00:00"
    after = _stamps(path)
    kept = {f: s for f, s in before.items() if any(f"day=2024-01-{d:02d}" in f for d in range(6, 11))}
    assert kept and all(after.get(f) == s for f, s in kept.items())
    assert not any("day=2024-01-04" in f for f in after)
    assert retention.drop_expired(spark, path, "at", "2024-01-10 12:00:00", "5 DAYS") == [] and _stamps(path) == after
    # a cutoff at midnight, one past all rows of its day, and one past everything
    assert retention.drop_expired(spark, path, "at", "2024-01-11 00:00:00", "5 DAYS") == ["2024-01-05"]
    assert retention.drop_expired(spark, path, "at", "2024-01-11 23:30:00", "5 DAYS") == ["2024-01-06"]
    assert retention.drop_expired(spark, path, "at", "2025-01-01 00:00:00", "5 DAYS") == [f"2024-01-{d:02d}" for d in range(7, 11)]


def test_retention_reads_one_day(spark):
    path = scratch_path(spark, "days2")
    retention.write_by_day(spark.range(96).select(F.timestamp_seconds(F.col("id") * 3600).alias("at")), path, "at")
    read = retention.day_rows(spark, path, "1970-01-02")
    assert read.count() == 24 and all("day=1970-01-02" in f for f in read.inputFiles())


def test_publish_replaces_in_one_step(spark):
    path = scratch_path(spark, "pointer") + "/CURRENT"
    assert files.published(spark, path) is None
    for v in ("1", "22", "3"):
        files.publish(spark, path, v)
        assert files.published(spark, path) == v
    assert files.names(spark, path.rsplit("/", 1)[0]) in (["CURRENT"], [".CURRENT.crc", "CURRENT"])
