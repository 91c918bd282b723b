"""Registered queries: telemetry."""

from __future__ import annotations

from linkstream.operators import telemetry as TM
from linkstream.plans.oracle_fixtures import with_views as V
from linkstream.plans.registry import query
from linkstream.sources import fixtures as FX
from linkstream.sources.tables import Tables


@query("table_counts", "A16", V("spans", "metric_points", "app_logs") + """
select 'spans' as table_name, count(*) as rows from spans
union all select 'metrics', count(*) from metric_points
union all select 'logs', count(*) from app_logs""")
def q_table_counts(spark, sf):
    t = Tables(spark, sf)
    return TM.table_counts({"spans": FX.spans(t), "metrics": FX.metric_points(t), "logs": FX.app_logs(t)})


@query("error_count_by_service", "A6", V("app_logs") + """
select service_name, count(*) as errors from app_logs
where level = 'ERROR' and timestamp >= timestamp '2024-01-30 23:59:59' - interval 1 hour group by service_name""")
def q_errors_hour(spark, sf):
    return TM.error_count_by_service(FX.app_logs(Tables(spark, sf)), FX.NOW, "1 HOUR")


@query("error_count_by_service_day", "A6", V("app_logs") + """
select service_name, count(*) as errors from app_logs
where level = 'ERROR' and timestamp >= timestamp '2024-01-30 23:59:59' - interval 1 day group by service_name""")
def q_errors_day(spark, sf):
    return TM.error_count_by_service(FX.app_logs(Tables(spark, sf)), FX.NOW, "1 DAY")


@query("metric_sum", "A10", V("metric_points") + """
select service, method, status_code, count(*) as value, round(sum(duration), 6) as duration_sum
from metric_points where name = 'http_requests_total' group by all""")
def q_metric_sum(spark, sf):
    return TM.metric_sum(FX.metric_points(Tables(spark, sf)), "http_requests_total",
                         ["service", "method", "status_code"])


@query("metric_sum_hourly", "A10", V("metric_points") + """
select date_trunc('hour', ts) as bucket, service, count(*) as value, round(sum(duration), 6) as duration_sum
from metric_points where name = 'http_requests_total' group by all""")
def q_metric_sum_hourly(spark, sf):
    return TM.metric_sum(FX.metric_points(Tables(spark, sf)), "http_requests_total", ["service"], bucket="hour")


@query("metric_sum_by_path", "A10", V("metric_points") + """
select method, path, status_code, cast(sum(amount) as bigint) as value, round(sum(duration), 6) as duration_sum
from metric_points where name = 'http_requests_total' group by all""")
def q_metric_sum_path(spark, sf):
    return TM.metric_sum(FX.metric_points(Tables(spark, sf)), "http_requests_total",
                         ["method", "path", "status_code"], amount="amount")


@query("metric_sum_by_reason", "A10", V("metric_points") + """
select reason, date_trunc('hour', ts) as bucket, cast(sum(amount) as bigint) as value, round(sum(duration), 6) as duration_sum
from metric_points where name = 'http_requests_total' and reason is not null group by all""")
def q_metric_sum_reason(spark, sf):
    points = FX.metric_points(Tables(spark, sf)).where("reason is not null")
    return TM.metric_sum(points, "http_requests_total", ["reason"], bucket="hour", amount="amount")


_EDGES = ", ".join(f"({e}::double)" for e in TM.DEFAULT_EDGES)


@query("latency_histogram", "A12", V("metric_points") + f"""
select p.method, p.status_code, count(*) as count, round(sum(p.duration), 6) as sum, e.le,
  cast(sum(case when p.duration <= e.le then 1 else 0 end) as bigint) as bucket_count
from metric_points p cross join (values {_EDGES}) e(le) group by p.method, p.status_code, e.le""")
def q_latency_histogram(spark, sf):
    return TM.latency_histogram(FX.metric_points(Tables(spark, sf)), ["method", "status_code"])


@query("service_red", "A13", V("metric_points") + """
select service, date_trunc('day', ts) as bucket, count(*) as requests,
  round(count(*) / 86400.0, 9) as rate_per_s,
  round(avg(case when status_code >= 500 then 1.0 else 0.0 end), 9) as error_rate,
  round(quantile_cont(duration, 0.5), 9) as p50, round(quantile_cont(duration, 0.9), 9) as p90,
  round(quantile_cont(duration, 0.99), 9) as p99
from metric_points group by all""")
def q_service_red(spark, sf):
    return TM.service_red(FX.metric_points(Tables(spark, sf)), "day")


_TRACE = """trace as (select trace_id, count(*) as n_spans, min(start_ts) as trace_start, max(duration_ms) as longest_ms,
  min(case when parent_span_id is null then service end) as root_service from spans group by trace_id)"""


@query("logs_for_trace", "J7", V("app_logs", "spans") + ", " + _TRACE + """
select l.trace_id, l.timestamp, l.service_name, l.level, l.attr_k, t.n_spans, t.trace_start, t.longest_ms,
  t.root_service from app_logs l left join trace t on t.trace_id = l.trace_id""")
def q_logs_for_trace(spark, sf):
    from pyspark.sql import functions as F
    t = Tables(spark, sf)
    logs = FX.app_logs(t).withColumn("attr_k", F.col("attributes")["k"]).drop("attributes")
    return TM.logs_for_trace(logs, FX.spans(t))


@query("trace_waterfall", "W6", V("spans") + ", " + _TRACE + """
select s.trace_id, s.span_id, s.parent_span_id, s.service, s.start_ts, s.duration_ms,
  (epoch_us(s.start_ts) - epoch_us(t.trace_start)) // 1000 as offset_ms,
  s.duration_ms = t.longest_ms as is_longest
from spans s join trace t on t.trace_id = s.trace_id""")
def q_trace_waterfall(spark, sf):
    return TM.trace_waterfall(FX.spans(Tables(spark, sf)))


@query("trace_tree", "W6", V("spans", recursive=True) + """,
up as (select s.*, p.span_id as up, epoch_us(s.start_ts) as b, epoch_us(s.start_ts) + s.duration_ms * 1000 as e
       from spans s left join spans p on p.trace_id = s.trace_id and p.span_id = s.parent_span_id),
ranked as (select *, up is null or row_number() over (partition by trace_id, up order by e desc, span_id) = 1 as last_child from up),
walk as (select trace_id, span_id, 0 as depth, true as on_path from ranked where up is null
  union all select r.trace_id, r.span_id, w.depth + 1, w.on_path and r.last_child
  from walk w join ranked r on r.trace_id = w.trace_id and r.up = w.span_id),
kids as (select k.trace_id, k.up as span_id, greatest(k.b, p.b) as b, least(k.e, p.e) as e
  from up k join up p on p.trace_id = k.trace_id and p.span_id = k.up where least(k.e, p.e) > greatest(k.b, p.b)),
runs as (select *, max(e) over (partition by trace_id, span_id order by b, e rows between unbounded preceding and 1 preceding) as before from kids),
busy as (select trace_id, span_id, sum(greatest(e - greatest(b, coalesce(before, b)), 0)) as covered from runs group by all),
start as (select trace_id, min(b) as t0 from up group by trace_id)
select u.trace_id, u.span_id, u.parent_span_id, u.service, cast(w.depth as bigint) as depth, (u.b - t.t0) // 1000 as offset_ms, u.duration_ms,
  round((u.duration_ms * 1000 - coalesce(k.covered, 0)) / 1000.0, 3) as self_ms, w.on_path as on_critical_path
from up u join start t on t.trace_id = u.trace_id join walk w on w.trace_id = u.trace_id and w.span_id = u.span_id
left join busy k on k.trace_id = u.trace_id and k.span_id = u.span_id""")
def q_trace_tree(spark, sf):
    return TM.trace_tree(FX.spans(Tables(spark, sf)))


@query("service_red_stored", "A13", V("metric_points") + """
select service, date_trunc('day', ts) as bucket, count(*) as requests, round(count(*) / 86400.0, 9) as rate_per_s,
  round(avg(case when status_code >= 500 then 1.0 else 0.0 end), 9) as error_rate
from metric_points group by all""")
def q_service_red_stored(spark, sf):
    """Daily figures from stored minutes, by way of stored hours; the sketches'
    quantiles are compared with exact ones in the tests."""
    from linkstream.session import scratch_path
    path = scratch_path(spark, "red")
    TM.red_partials(FX.metric_points(Tables(spark, sf))).write.parquet(f"{path}/minute")
    TM.merge_red(spark.read.parquet(f"{path}/minute"), "hour").write.parquet(f"{path}/hour")
    return TM.red_from_partials(spark.read.parquet(f"{path}/hour"), "day").drop("p50", "p90", "p99")


@query("service_map", "J8", V("spans") + """
select p.service as caller, c.service as callee, count(*) as calls,
  round(count(*) / greatest((epoch_us(max(c.start_ts)) - epoch_us(min(c.start_ts))) / 1000000.0, 1.0), 9) as calls_per_s,
  round(avg(case when c.status = 'ERROR' then 1.0 else 0.0 end), 9) as error_share,
  round(avg(c.duration_ms), 6) as avg_ms, max(c.duration_ms) as max_ms
from spans c join spans p on p.trace_id = c.trace_id and p.span_id = c.parent_span_id group by all""")
def q_service_map(spark, sf):
    return TM.service_map(FX.spans(Tables(spark, sf)))


@query("service_map_hourly", "J8", V("spans") + """
select date_trunc('hour', c.start_ts) as bucket, p.service as caller, c.service as callee, count(*) as calls,
  round(count(*) / 3600.0, 9) as calls_per_s,
  round(avg(case when c.status = 'ERROR' then 1.0 else 0.0 end), 9) as error_share,
  round(avg(c.duration_ms), 6) as avg_ms, max(c.duration_ms) as max_ms
from spans c join spans p on p.trace_id = c.trace_id and p.span_id = c.parent_span_id group by all""")
def q_service_map_hourly(spark, sf):
    return TM.service_map(FX.spans(Tables(spark, sf)), bucket="hour")
