"""Telemetry: metric sums, histograms, RED figures, logs, traces, service map.

Per-trace figures (trace start, longest span) are computed as a grouped
aggregate joined back many-to-one, not as a window over the trace, so a
huge trace is pre-reduced on the map side and its join partition is split by
AQE (``plans.joins.skew_safe_join``).  Parent/child edges are a one-to-one
equi-join on (trace_id, span_id): each child has one parent, no pairs are
emitted.  The nested view walks up the span tree by pointer doubling, a round
for each power of two of its depth.  RED figures also come from stored partials
of a service and minute, whose quantile sketches merge into any longer period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstream.functions.timefns import recent, start_of_hour
from linkstream.plans.joins import skew_safe_join
from linkstream.plans.ranking import join_null_safe, exact_quantiles, stable
from linkstream.plans.scan import ordered, scan_max
from linkstream.schemas import TELEMETRY

BUCKET_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}
DEFAULT_EDGES = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def read_telemetry(spark, path: str, kind: str, fmt: str = "parquet") -> DataFrame:
    """Spans / metrics / logs table of a telemetry export."""
    if kind not in TELEMETRY:
        raise ValueError(kind)
    return spark.read.format(fmt).load(f"{path.rstrip('/')}/{kind}")


# The collector's batches: every second, of this many rows or so a message file.
TELEMETRY_TRIGGER = {"processingTime": "1 second"}


def read_telemetry_stream(spark, path: str, kind: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """The spans / metrics / logs of a telemetry export as a stream of its files."""
    reader = spark.readStream.schema(TELEMETRY[kind]).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(f"{path.rstrip('/')}/{kind}")


def stream_telemetry(stream: DataFrame, path: str, kind: str, checkpoint: str, trigger: dict | None = None):
    """Keep one kind's stream as a table that ``read_committed`` reads, each batch once."""
    from linkstream.sources.committed import write_committed
    return write_committed(stream, f"{path.rstrip('/')}/{kind}", f"{checkpoint.rstrip('/')}/{kind}", trigger or TELEMETRY_TRIGGER)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def error_count_by_service(logs: DataFrame, now: str, window: str = "1 HOUR") -> DataFrame:
    errors = recent(logs.where(F.col("level") == "ERROR"), "timestamp", now, window)
    return errors.groupBy("service_name").agg(F.count(F.lit(1)).alias("errors")).orderBy(F.desc("errors"))


def metric_sum(points: DataFrame, name: str, by: list[str], bucket: str | None = None,
               amount: str | None = None) -> DataFrame:
    """Counter total by attributes, plus the summed duration when the points
    carry one.  A point adds its ``amount`` column (a null one adds nothing),
    or 1 without such a column."""
    keys = list(by)
    p = points.where(F.col("name") == name)
    if bucket:
        keys = [start_of_hour("ts").alias("bucket") if bucket == "hour"
                else F.date_trunc(bucket, "ts").alias("bucket")] + keys
    aggs = [(F.coalesce(F.sum(amount), F.lit(0)) if amount else F.count(F.lit(1))).alias("value")]
    if "duration" in points.columns:
        aggs.append(F.round(F.sum("duration"), 6).alias("duration_sum"))
    return p.groupBy(*keys).agg(*aggs)


def latency_histogram(points: DataFrame, by: list[str], edges=DEFAULT_EDGES,
                      value: str = "duration") -> DataFrame:
    """Cumulative bucket counts (``le``) per key, with count and sum, in long
    form: one pass of conditional sums, then ``stack``."""
    sums = [F.sum((F.col(value) <= F.lit(e)).cast("bigint")).alias(f"b{i}") for i, e in enumerate(edges)]
    wide = points.groupBy(*by).agg(F.count(F.lit(1)).alias("count"),
                                   F.round(F.sum(value), 6).alias("sum"), *sums)
    pairs = ", ".join(f"cast({e} as double), b{i}" for i, e in enumerate(edges))
    stacked = wide.selectExpr(*[f"`{c}`" for c in by], "count", "sum",
                              f"stack({len(edges)}, {pairs}) as (le, bucket_count)")
    return stacked


def service_red(points: DataFrame, bucket: str = "day", exact: bool = True,
                service: str = "service", ts: str = "ts", duration: str = "duration",
                status: str = "status_code") -> DataFrame:
    """Rate, errors, duration (p50/p90/p99) per service and time bucket.

    ``exact`` computes the quantiles by a distributed sort
    (``plans.ranking.exact_quantiles``), so no service's values are ever
    gathered in one task; ``exact=False`` uses ``percentile_approx`` (one
    pass, fixed memory per group).
    """
    seconds = BUCKET_SECONDS[bucket]
    keyed = points.withColumn("bucket", F.date_trunc(bucket, ts))
    agg = (keyed.groupBy(service, "bucket")
                .agg(F.count(F.lit(1)).alias("requests"),
                     F.avg((F.col(status) >= 500).cast("double")).alias("error_rate")))
    if exact:
        qs = exact_quantiles(keyed, [service, "bucket"], duration, [0.5, 0.9, 0.99], ["_p50", "_p90", "_p99"])
        agg = join_null_safe(agg, qs, [service, "bucket"], "left")
    else:
        approx = (keyed.groupBy(service, "bucket")
                       .agg(F.percentile_approx(duration, [0.5, 0.9, 0.99], 10000).alias("_a")))
        agg = join_null_safe(agg, approx.select(service, "bucket", *[F.col("_a")[i].alias(n) for i, n in
                                                                    enumerate(["_p50", "_p90", "_p99"])]),
                              [service, "bucket"], "left")
    return agg.select(service, "bucket", "requests",
                      F.round(F.col("requests") / F.lit(float(seconds)), 9).alias("rate_per_s"),
                      F.round("error_rate", 9).alias("error_rate"),
                      F.round("_p50", 9).alias("p50"), F.round("_p90", 9).alias("p90"),
                      F.round("_p99", 9).alias("p99"))


def _trace_summary(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.min("start_ts").alias("trace_start"),
        F.max("duration_ms").alias("longest_ms"),
        F.min(F.when(F.col("parent_span_id").isNull(), F.col("service"))).alias("root_service"))


def logs_for_trace(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every log line with its trace's summary (NULLs when the trace has no span)."""
    return skew_safe_join(logs, _trace_summary(spans), "trace_id")


def trace_waterfall(spans: DataFrame) -> DataFrame:
    """Spans with their offset from the trace start; the longest span flagged."""
    s = _trace_summary(spans).select("trace_id", "trace_start", "longest_ms")
    j = skew_safe_join(spans, s, "trace_id", "inner")
    offset_ms = (F.unix_micros("start_ts") - F.unix_micros("trace_start")) / F.lit(1000)
    return j.select("trace_id", "span_id", "parent_span_id", "service", "start_ts", "duration_ms",
                    F.floor(offset_ms).cast("bigint").alias("offset_ms"),
                    (F.col("duration_ms") == F.col("longest_ms")).alias("is_longest"))


def _depths(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth, on_path): steps up to the root, and whether
    every span on that way is the last of its siblings to end.  Pointer
    doubling: a round looks twice as far up, until no span has further to go; a
    span whose parent is not there is a root, and one on a ring of parents has no depth."""
    parent = spans.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_p"))
    known = spans.join(parent, (F.col("trace_id") == F.col("_t")) & (F.col("parent_span_id") == F.col("_p")), "left")
    end = F.unix_micros("start_ts") + F.col("duration_ms") * 1000
    last = (known.where(F.col("_p").isNotNull()).groupBy("trace_id", F.col("_p").alias("_up"))
                 .agg(F.max_by("span_id", F.struct(end, -F.col("span_id"))).alias("_last")))
    up = known.select("trace_id", "span_id", F.col("_p").alias("up"))
    hop = (up.join(last.withColumnRenamed("trace_id", "_t"), (F.col("trace_id") == F.col("_t")) & (F.col("up") == F.col("_up")), "left")
             .select("trace_id", "span_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
                     F.when(F.col("up").isNull(), True).otherwise(F.col("span_id") == F.col("_last")).alias("on_path")))
    hop = stable(hop)
    left, rounds = hop.where("up is not null").count(), 0
    total = max(hop.count(), 1)
    while left and rounds <= total.bit_length():
        far = hop.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("up").alias("_up"),
                         F.col("depth").alias("_d"), F.col("on_path").alias("_ok"))
        going = (hop.where("up is not null").join(far, (F.col("trace_id") == F.col("_t")) & (F.col("up") == F.col("_s")))
                    .select("trace_id", "span_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"),
                            (F.col("on_path") & F.col("_ok")).alias("on_path")))
        hop = stable(hop.where("up is null").unionByName(going))
        left, rounds = hop.where("up is not null").count(), rounds + 1
    there = F.col("up").isNull()
    return hop.select("trace_id", "span_id", F.when(there, F.col("depth")).alias("depth"), (there & F.col("on_path")).alias("on_path"))


def _self_times(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, covered_us): how much of each parent its children
    cover.  A child's new stretch begins where its earlier siblings end, which
    is a running maximum over the siblings by start, cut into ranges of rows."""
    kids = spans.where(F.col("parent_span_id").isNotNull()).select(
        "trace_id", F.col("parent_span_id").alias("span_id"), F.unix_micros("start_ts").alias("_s"),
        (F.unix_micros("start_ts") + F.col("duration_ms") * 1000).alias("_e"))
    own = spans.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_p"), F.unix_micros("start_ts").alias("_ps"),
                       (F.unix_micros("start_ts") + F.col("duration_ms") * 1000).alias("_pe"))
    inside = (kids.join(own, (F.col("trace_id") == F.col("_t")) & (F.col("span_id") == F.col("_p")))
                  .select("trace_id", "span_id", F.greatest("_s", "_ps").alias("_s"), F.least("_e", "_pe").alias("_e"))
                  .where(F.col("_e") > F.col("_s")))
    rows = scan_max(ordered(inside, ["trace_id", "span_id"], ["_s", "_e"]), ["trace_id", "span_id"], F.col("_e"), "_before")
    fresh = F.greatest(F.col("_e") - F.greatest(F.col("_s"), F.coalesce(F.col("_before"), F.col("_s"))), F.lit(0))
    return rows.groupBy("trace_id", "span_id").agg(F.sum(fresh).alias("covered_us"))


def trace_tree(spans: DataFrame) -> DataFrame:
    """The nested waterfall: each span with its depth, its offset from the trace
    start, the time it spent itself (its duration less what its children cover),
    and whether it lies on the critical path (the way from a root that always
    follows the child that ends last, the smaller id among equals)."""
    at = F.col("trace_id").eqNullSafe(F.col("_t")) & F.col("span_id").eqNullSafe(F.col("_s"))
    deep = _depths(spans).select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), "depth", "on_path")
    busy = _self_times(spans).select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), "covered_us")
    out = trace_waterfall(spans).join(deep, at, "left").drop("_t", "_s").join(busy, at, "left").drop("_t", "_s")
    self_us = F.col("duration_ms") * 1000 - F.coalesce("covered_us", F.lit(0))
    return out.select("trace_id", "span_id", "parent_span_id", "service", "depth", "offset_ms", "duration_ms",
                      F.round(self_us / 1000, 3).alias("self_ms"), F.col("on_path").alias("on_critical_path"))


# Items of a level of a quantile sketch: ranks are off by about 1.7 / K at the 99 % level.
KLL_K = 800


def red_partials(points: DataFrame, period: str = "minute", service: str = "service", ts: str = "ts",
                 duration: str = "duration", status: str = "status_code") -> DataFrame:
    """What a service's period adds to any longer one: requests, errors, and a
    mergeable sketch of the durations (null ones are in no sketch)."""
    return (points.groupBy(F.col(service).alias("service"), F.date_trunc(period, ts).alias("period"))
                  .agg(F.count(F.lit(1)).alias("requests"), F.sum(F.coalesce(F.col(status) >= 500, F.lit(False)).cast("bigint")).alias("errors"),
                       F.kll_sketch_agg_double(F.col(duration).cast("double"), F.lit(KLL_K)).alias("durations")))


def merge_red(partials: DataFrame, period: str) -> DataFrame:
    """Partials of a longer period from those of shorter ones (or several of one period)."""
    return (partials.groupBy("service", F.date_trunc(period, "period").alias("period"))
                    .agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"),
                         F.kll_merge_agg_double("durations").alias("durations")))


def red_from_partials(partials: DataFrame, period: str) -> DataFrame:
    """Rate, error share and quantiles (a value seen, the least whose rank
    reaches the share) per service and period, from stored partials alone."""
    merged = merge_red(partials, period)
    some = F.kll_sketch_get_n_double("durations") > 0
    q = [F.when(some, F.kll_sketch_get_quantile_double("durations", F.lit(p))).alias(n)
         for p, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    return merged.select("service", F.col("period").alias("bucket"), "requests",
                         F.round(F.col("requests") / F.lit(float(BUCKET_SECONDS[period])), 9).alias("rate_per_s"),
                         F.round(F.col("errors") / F.col("requests"), 9).alias("error_rate"), *q)


def service_map(spans: DataFrame, bucket: str | None = None) -> DataFrame:
    """caller -> callee edges with call count, rate, share of callee spans in
    error, and callee latency.  The rate is over the bucket, or over the time
    from an edge's first call to its last (a second at least)."""
    parent = spans.select(F.col("trace_id").alias("_pt"), F.col("span_id").alias("_ps"),
                          F.col("service").alias("caller"))
    child = spans.select("trace_id", "parent_span_id", F.col("service").alias("callee"), "duration_ms", "start_ts",
                         F.coalesce(F.col("status") == "ERROR", F.lit(False)).cast("double").alias("_error"))
    edges = child.join(parent, (F.col("trace_id") == F.col("_pt")) & (F.col("parent_span_id") == F.col("_ps")))
    keys = ["caller", "callee"]
    if bucket:
        keys = [F.date_trunc(bucket, "start_ts").alias("bucket")] + keys
    at = F.unix_micros("start_ts")
    seconds = (F.lit(float(BUCKET_SECONDS[bucket])) if bucket
               else F.greatest((F.max(at) - F.min(at)) / 1_000_000, F.lit(1.0)))
    return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"),
                                    F.round(F.count(F.lit(1)) / seconds, 9).alias("calls_per_s"),
                                    F.round(F.avg("_error"), 9).alias("error_share"),
                                    F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
                                    F.max("duration_ms").alias("max_ms"))
