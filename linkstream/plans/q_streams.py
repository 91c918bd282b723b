"""Registered queries that run Structured Streaming jobs to completion
(trigger ``availableNow``) over message files Spark derives from the
driver tables, then return what the sink holds (S1, S3, S6, S8, R1-R3,
R5, R7, R10, A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkstream.operators import links as L
from linkstream.operators import rollup as R
from linkstream.operators.rollup import compact_rollup
from linkstream.plans.q_clicks import _PARSED
from linkstream.plans.q_links import _LIVES
from linkstream.plans.oracle_fixtures import with_views as V
from linkstream.plans.registry import query
from linkstream.schemas import TELEMETRY
from linkstream.session import rocksdb_state, scratch_path
from linkstream.sources import files
from linkstream.sources import fixtures as FX
from linkstream.sources.streams import read_clicks_stream
from linkstream.sources.tables import Tables
from linkstream.streaming import alerts as AL
from linkstream.streaming import ingest as IN
from linkstream.streaming import keyed as KS


def _message_files(spark, df, name, fmt="json", files=4):
    path = scratch_path(spark, name)
    df.repartition(files).write.mode("overwrite").format(fmt).save(path)
    return path


def _thirds(df, ts):
    """``df`` in three parts, one after the other in time."""
    at = F.unix_micros(ts)
    lo, hi = df.agg(F.coalesce(F.min(at), F.lit(0)), F.coalesce(F.max(at), F.lit(0))).first()
    a, b = lo + (hi - lo) // 3, lo + 2 * (hi - lo) // 3
    return [df.where(at < a), df.where((at >= a) & (at < b)), df.where(at >= b)]


def _far_row(df, ts, after="1 DAY"):
    """One row without key, a day after all others: it moves the watermark
    past the end of a finite stream, so that its last windows close too."""
    end = df.agg(F.max(ts).alias("end")).where(F.col("end").isNotNull())
    return end.select(*[(F.col("end") + F.expr(f"INTERVAL {after}") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in df.schema])


def _run_in_parts(parts, path, fmt, start):
    """Add one part of the messages, run the stream on from its checkpoint, and
    so on: several micro-batches, with state carried over restarts."""
    for part in parts:
        part.write.mode("append").format(fmt).save(path)
        start().awaitTermination()


@query("stream_hourly_rollup", "R2, S1, S8, A3, R7", _PARSED + """
select date_trunc('hour', event_time) as hour, short_code, country_code, count(*) as total_clicks
from p where ok group by all""")
def q_stream_rollup(spark, sf):
    t = Tables(spark, sf)
    src = _message_files(spark, FX.click_json(t), "click-msgs")
    out, ck = scratch_path(spark, "rollup"), scratch_path(spark, "rollup-ck")
    cfg = {"format": "json", "path": src, "schema": "event_id long, value string", "max_files_per_trigger": 2}
    q = IN.stream_hourly_rollup(read_clicks_stream(spark, cfg), out, ck, {"availableNow": True})
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    if last > 0:
        IN.compact_rollup_job(spark, out, last - 1)  # fold all but the newest batch
    return compact_rollup(IN.read_rollup(spark, out))


def _visitors_sql(period, by):
    return _PARSED + f"""
select date_trunc('{period}', event_time) as period, {by} count(distinct concat(country_code, '/', user_agent)) as visitors
from p where ok group by all"""


def _stored_visitors(spark, sf, period, by):
    """From a stored roll-up of several batches, the older ones compacted twice."""
    src, out = _message_files(spark, FX.click_json(Tables(spark, sf)), "visit-msgs", files=6), scratch_path(spark, "visits")
    cfg = {"format": "json", "path": src, "schema": "event_id long, value string", "max_files_per_trigger": 1}
    q = IN.stream_hourly_rollup(read_clicks_stream(spark, cfg), out, scratch_path(spark, "visits-ck"), {"availableNow": True},
                                compact_every=2, visitor=F.concat("country_code", F.lit("/"), "user_agent"))
    q.awaitTermination()
    return R.unique_visitors(IN.read_rollup(spark, out, visitors=True), period, by)


@query("unique_visitors_hourly", "A1, A3, 2.12", _visitors_sql("hour", "short_code,"))
def q_visitors_hourly(spark, sf):
    return _stored_visitors(spark, sf, "hour", ["short_code"])


@query("unique_visitors_daily", "A3, 2.12", _visitors_sql("day", ""))
def q_visitors_daily(spark, sf):
    return _stored_visitors(spark, sf, "day", [])


@query("stream_bot_timers", "R5, R1, R8, 2.12", V("redirect_requests") + """,
c as (select short_code, date_trunc('day', ts) as window_start, count(*) as n from redirect_requests group by all having count(*) > 3)
select short_code, window_start, window_start + interval 1 day as window_end, 'crossed' as kind, 4 as events from c
union all select short_code, window_start, window_start + interval 1 day, 'closed', n from c""")
def q_stream_bot_timers(spark, sf):
    """Four runs over one checkpoint, then one whose rows are all too late: the
    first third again, days behind the watermark, which changes nothing."""
    reqs = FX.redirect_requests(Tables(spark, sf))
    src, out, ck = (scratch_path(spark, n) for n in ("timer-rows", "timer-alerts", "timer-ck"))

    def start():
        alerts = KS.stream_bot_timers(spark.readStream.schema(reqs.schema).parquet(src), "short_code", "ts", 3, 86400)
        with rocksdb_state(spark):
            return (alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                          .trigger(availableNow=True).start())

    parts = _thirds(reqs, "ts")
    _run_in_parts([*parts, _far_row(reqs, "ts", "3 DAYS"), parts[0]], src, "parquet", start)
    return spark.read.parquet(out)


@query("stream_cached_lookups", "J5, 2.12", V("redirect_requests", "url_mappings") + """,
n as (select r.short_code, m.long_url is not null as found, count(*) as n from redirect_requests r
      left join url_mappings m on m.id = r.short_code group by all)
select short_code, 'db_stale' as source, 1 as requests from n where found
union all select short_code, 'redis', n - 1 from n where found and n > 1
union all select short_code, 'url_not_found_db', n from n where not found""")
def q_stream_cached_lookups(spark, sf):
    """Which requests the cache answers: all but the first of a code, while its
    answer is kept.  One batch a run: state with a processing-time TTL asks for
    another batch as long as a stream runs."""
    t = Tables(spark, sf)
    m = FX.url_mappings(t).select(F.col("id").alias("short_code"), F.col("long_url").alias("table_url"))
    reqs = FX.redirect_requests(t).join(m, "short_code", "left")
    src, out, ck = (scratch_path(spark, n) for n in ("lookup-rows", "lookups", "lookup-ck"))

    def start():
        found = KS.stream_cached_lookups(spark.readStream.schema(reqs.schema).parquet(src), ttl="1 day")
        with rocksdb_state(spark):
            return (found.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                         .trigger(once=True).start())

    _run_in_parts(_thirds(reqs, "ts"), src, "parquet", start)
    return spark.read.parquet(out).groupBy("short_code", "source").agg(F.count(F.lit(1)).alias("requests"))


@query("stream_bot_lifetime", "R5b", V("redirect_requests") + """
select request_id, ts, short_code, cnt as count from (
  select *, count(*) over (partition by short_code order by ts, request_id
                           rows between unbounded preceding and current row) as cnt from redirect_requests)
where cnt > 60""")
def q_stream_bot_lifetime(spark, sf):
    t = Tables(spark, sf)
    reqs = FX.redirect_requests(t)
    src, out, ck = (scratch_path(spark, n) for n in ("redirect-msgs", "bot-alerts", "bot-ck"))

    def start():
        stream = spark.readStream.schema(reqs.schema).parquet(src)
        alerts = AL.stream_bot_lifetime(stream, "short_code", "ts", 60, tiebreak="request_id")
        return (alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                      .trigger(availableNow=True).start())

    _run_in_parts(_thirds(reqs, "ts"), src, "parquet", start)
    return spark.read.parquet(out)


@query("stream_trending", "R3, R1, R8", V("clicks") + """,
w as (select date_trunc('minute', event_time) - to_minutes(k) as window_start, short_code
      from clicks, range(15) r(k)),
c as (select window_start, window_start + interval 15 minute as window_end, short_code, count(*) as clicks
      from w group by all),
r as (select *, row_number() over (partition by window_start order by clicks desc, short_code) as rank from c)
select * from r where rank <= 10""")
def q_stream_trending(spark, sf):
    t = Tables(spark, sf)
    clicks = FX.clicks(t)
    src, out, ck = (scratch_path(spark, n) for n in ("click-rows", "trending", "trending-ck"))

    def start():
        return AL.stream_trending(spark.readStream.schema(clicks.schema).parquet(src), out, ck, n=10,
                                  trigger={"availableNow": True})

    _run_in_parts([*_thirds(clicks, "event_time"), _far_row(clicks, "event_time")], src, "parquet", start)
    return spark.read.parquet(out).drop("batch_id")


@query("stream_split_clicks", "R6", _PARSED + "select event_id, route from p")
def q_stream_split(spark, sf):
    t = Tables(spark, sf)
    src = _message_files(spark, FX.click_json(t), "split-msgs")
    base = scratch_path(spark, "split")
    paths = {r: f"{base}/{r}" for r in ("main", "bot", "reject")}
    cfg = {"format": "json", "path": src, "schema": "event_id long, value string", "max_files_per_trigger": 2}
    q = IN.stream_split_clicks(read_clicks_stream(spark, cfg), paths, scratch_path(spark, "split-ck"),
                               {"availableNow": True})
    q.awaitTermination()
    parts = [spark.read.parquet(p).select("event_id", F.lit(r).alias("route")) for r, p in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("links_change_feed", "R10", _LIVES + """
select id as key, id as value from verdict where accepted and op = 'insert'""")
def q_change_feed(spark, sf):
    _, applied, _ = L.apply_mutations(None, FX.link_mutations(Tables(spark, sf)))
    created, _ = IN.links_change_feed(applied)
    return created


@query("stream_links_change_feed", "R10", _LIVES + """
select 'created' as feed, id as code from verdict where accepted and op = 'insert'
union all select distinct 'known', id from verdict where accepted and op = 'insert'""")
def q_stream_change_feed(spark, sf):
    _, applied, _ = L.apply_mutations(None, FX.link_mutations(Tables(spark, sf)))
    rows = applied.select("id", "op", "commit_ts")
    src, out, ck = (scratch_path(spark, n) for n in ("applied-rows", "change-feed", "change-feed-ck"))

    def start():
        return IN.stream_links_change_feed(spark.readStream.schema(rows.schema).parquet(src), out, ck, {"availableNow": True})

    _run_in_parts(_thirds(rows, "commit_ts"), src, "parquet", start)
    created = spark.read.parquet(f"{out}/created").select(F.lit("created").alias("feed"), F.col("key").alias("code"))
    return created.unionByName(IN.read_known(spark, out).select(F.lit("known").alias("feed"), F.col("short_code").alias("code")))


@query("stream_time_to_first_click", "J9", V("created_events", "clicks") + """
select c.key as short_code, c.timestamp as created_at, min(k.event_time) as first_click,
  (epoch_us(min(k.event_time)) - epoch_us(c.timestamp)) // 1000000 as seconds_to_first_click
from created_events c join clicks k on k.short_code = c.key
 and k.event_time >= c.timestamp and k.event_time <= c.timestamp + interval 2 day
group by c.key, c.timestamp""")
def q_stream_ttfc(spark, sf):
    t = Tables(spark, sf)
    made, used = FX.created_events(t).select("key", "timestamp"), FX.clicks(t).select("short_code", "event_time")
    made_src, used_src, out, ck = (scratch_path(spark, n) for n in ("ttfc-made", "ttfc-clicks", "ttfc", "ttfc-ck"))

    def start():
        first = AL.stream_time_to_first_click(spark.readStream.schema(made.schema).parquet(made_src),
                                              spark.readStream.schema(used.schema).parquet(used_src), "2 DAYS")
        return (first.writeStream.format("parquet").option("path", out).outputMode("append")
                     .option("checkpointLocation", ck).trigger(availableNow=True).start())

    # Both streams end long after their last row, past every open interval.  The
    # join drops rows without key before their time is seen, so these have one each.
    ends = [_far_row(made, "timestamp", "60 DAYS").withColumn("key", F.lit("end of creations")),
            _far_row(used, "event_time", "60 DAYS").withColumn("short_code", F.lit("end of clicks"))]
    for new, clicked in zip([*_thirds(made, "timestamp"), ends[0]], [*_thirds(used, "event_time"), ends[1]]):
        new.write.mode("append").parquet(made_src)
        _run_in_parts([clicked], used_src, "parquet", start)
    return spark.read.parquet(out)


@query("stream_clicks_sink", "S6", _PARSED + "select event_time, short_code, country_code from p where ok")
def q_stream_sink(spark, sf):
    from linkstream.operators.clicks import parse_clicks
    from linkstream.sources.sinks import write_clicks_jdbc
    src = _message_files(spark, FX.click_json(Tables(spark, sf)), "sink-msgs")
    out = scratch_path(spark, "click-sink")
    cfg = {"format": "json", "path": src, "schema": "event_id long, value string", "max_files_per_trigger": 2}
    clicks, _ = parse_clicks(read_clicks_stream(spark, cfg))
    q = (clicks.writeStream.foreachBatch(write_clicks_jdbc({"path": out}))
               .option("checkpointLocation", scratch_path(spark, "sink-ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("event_time", "short_code", "country_code")


@query("stream_created_per_hour", "S3, A15", V("created_events") + """
select date_trunc('hour', timestamp) as hour, count(*) as created from created_events group by all""")
def q_stream_created(spark, sf):
    from linkstream.operators.rollup import created_per_hour
    from linkstream.sources.streams import read_created_stream
    created = FX.created_events(Tables(spark, sf))
    src, out, ck = (scratch_path(spark, n) for n in ("created-msgs", "created-sink", "created-ck"))

    def start():
        stream = read_created_stream(spark, {"format": "json", "path": src,
                                             "schema": "key string, value string, timestamp timestamp"})
        once = IN.dedup_stream(stream, ["key", "value"], "timestamp")
        return (once.writeStream.format("parquet").option("path", out)
                    .option("checkpointLocation", ck).trigger(availableNow=True).start())

    # Two feed replicas, the second one part behind the first.
    x, y, z = _thirds(created, "timestamp")
    _run_in_parts([x.unionByName(x), y.unionByName(x), z.unionByName(y), z], src, "json", start)
    return created_per_hour(spark.read.parquet(out))


@query("read_telemetry_counts", "S9, A16", V("spans", "metric_points", "app_logs") + """
select 'spans' as table_name, count(*) as rows from spans
union all select 'metrics', count(*) from metric_points
union all select 'logs', count(*) from app_logs""")
def q_read_telemetry(spark, sf):
    from linkstream.operators.telemetry import read_telemetry, table_counts
    t = Tables(spark, sf)
    base = scratch_path(spark, "telemetry")
    for kind, df in (("spans", FX.spans(t)), ("metrics", FX.metric_points(t)), ("logs", FX.app_logs(t))):
        df.write.mode("overwrite").parquet(f"{base}/{kind}")
    return table_counts({k: read_telemetry(spark, base, k) for k in ("spans", "metrics", "logs")})


@query("stream_sessions", "R4", V("user_events") + """,
s as (select user_id, timestamp, sum(case when prev is null or epoch_us(timestamp) - epoch_us(prev) >= 1800000000
        then 1 else 0 end) over (partition by user_id order by timestamp rows between unbounded preceding and current row) as sid
      from (select *, lag(timestamp) over (partition by user_id order by timestamp) as prev from user_events)),
g as (select user_id, min(timestamp) as session_start, max(timestamp) + interval 30 minute as session_end,
        count(*) as events from s group by user_id, sid)
select * from g""")
def q_stream_sessions(spark, sf):
    ev = FX.user_events(Tables(spark, sf))
    src, out, ck = (scratch_path(spark, n) for n in ("session-rows", "sessions", "sessions-ck"))

    def start():
        sess = AL.stream_sessions(spark.readStream.schema(ev.schema).parquet(src), "user_id", "30 minutes", ts="timestamp")
        return (sess.writeStream.format("parquet").option("path", out).outputMode("append")
                    .option("checkpointLocation", ck).trigger(availableNow=True).start())

    _run_in_parts([*_thirds(ev, "timestamp"), _far_row(ev, "timestamp")], src, "parquet", start)
    return spark.read.parquet(out)


@query("stream_top_links", "R12, J1", _PARSED + """,
hourly as (select date_trunc('hour', event_time) as hour, short_code, country_code, count(*) as total_clicks
           from p where ok group by all),
totals as (select short_code, cast(sum(total_clicks) as bigint) as total_clicks from hourly group by short_code),
m as (""" + """select lpad(cast(page_id as varchar(20)),11,'0') as id, url as long_url from pages where page_id % 7 <> 3),
top as (select * from totals order by total_clicks desc, short_code limit 10),
e as (select t.short_code, l.long_url, t.total_clicks from top t join m l on t.short_code = l.id)
select '{"top_links":[' || coalesce(string_agg(json_object('short_code', short_code, 'long_url', long_url,
  'total_clicks', total_clicks)::varchar, ',' order by total_clicks desc, short_code), '') || ']}' as json from e""")
def q_stream_top_links(spark, sf):
    t = Tables(spark, sf)
    src = _message_files(spark, FX.click_json(t), "top-msgs")
    path = scratch_path(spark, "top")
    cfg = {"format": "json", "path": src, "schema": "event_id long, value string", "max_files_per_trigger": 2}
    q = IN.stream_top_links(read_clicks_stream(spark, cfg), FX.url_mappings(t), path,
                            scratch_path(spark, "top-ck"), trigger={"availableNow": True})
    q.awaitTermination()
    return IN.read_top_links(spark, path)


@query("stream_known_code_guard", "J4, J5", V("redirect_requests", "created_events") + """
select r.*, c.timestamp as created_at, case when c.value is null then 'url_not_found_bloom' end as outcome
from redirect_requests r left join created_events c on c.value = r.short_code and c.timestamp <= r.ts
  and c.timestamp >= r.ts - interval 40 day""")
def q_stream_guard(spark, sf):
    t = Tables(spark, sf)
    made, asked = FX.created_events(t).select("value", "timestamp"), FX.redirect_requests(t)
    made_src, asked_src, out, ck = (scratch_path(spark, n) for n in ("guard-made", "guard-asked", "guard", "guard-ck"))

    def start():
        found = AL.stream_known_code_guard(spark.readStream.schema(asked.schema).parquet(asked_src),
                                           spark.readStream.schema(made.schema).parquet(made_src))
        return (found.writeStream.format("parquet").option("path", out).outputMode("append")
                     .option("checkpointLocation", ck).trigger(availableNow=True).start())

    # Rows long after the last ones end both streams (with keys: the join does not see times of rows without).
    ends = [_far_row(made, "timestamp", "60 DAYS").withColumn("value", F.lit("end of creations")),
            _far_row(asked, "ts", "60 DAYS").withColumn("short_code", F.lit("end of requests"))]
    for new, used in zip([*_thirds(made, "timestamp"), ends[0]], [*_thirds(asked, "ts"), ends[1]]):
        new.write.mode("append").parquet(made_src)
        _run_in_parts([used], asked_src, "parquet", start)
    return spark.read.parquet(out)


@query("stream_committed_sink", "S6, R7", _PARSED + "select event_time, short_code, country_code from p where ok")
def q_committed_sink(spark, sf):
    """Clicks in a table to which each batch is added once; the last batch runs again."""
    from linkstream.operators.clicks import parse_clicks, project_click
    from linkstream.sources.committed import read_committed, write_committed
    src = _message_files(spark, FX.click_json(Tables(spark, sf)), "commit-msgs")
    out, ck = scratch_path(spark, "committed"), scratch_path(spark, "committed-ck")
    cfg = {"format": "json", "path": src, "schema": "event_id long, value string", "max_files_per_trigger": 2}

    def start():
        clicks, _ = parse_clicks(read_clicks_stream(spark, cfg))
        return write_committed(project_click(clicks), out, ck, {"availableNow": True})

    first = start()
    first.awaitTermination()
    # As after a crash between the sink's commit and the stream's: the batch is not logged as done.
    last = first.lastProgress["batchId"] if first.lastProgress else 0
    files.remove(spark, f"{ck}/commits/{last}")
    start().awaitTermination()
    return read_committed(spark, out, "event_time timestamp, short_code string, country_code string")


@query("stream_telemetry", "S9, A16", V("spans", "metric_points", "app_logs") + """
select 'spans' as table_name, count(*) as rows from spans
union all select 'metrics', count(*) from metric_points
union all select 'logs', count(*) from app_logs""")
def q_stream_telemetry(spark, sf):
    """Three streams of message files, each kept as a table in small batches."""
    from linkstream.operators import telemetry as TM
    from linkstream.sources.committed import read_committed
    t = Tables(spark, sf)
    tables = {"spans": FX.spans(t), "metrics": FX.metric_points(t), "logs": FX.app_logs(t)}
    src, out, ck = (scratch_path(spark, n) for n in ("telemetry-msgs", "telemetry-tables", "telemetry-ck"))
    for kind, df in tables.items():
        df.repartition(4).write.json(f"{src}/{kind}")
    running = [TM.stream_telemetry(TM.read_telemetry_stream(spark, src, kind, max_files=1), out, kind, ck, {"availableNow": True})
               for kind in tables]
    for q in running:
        q.awaitTermination()
    return TM.table_counts({kind: read_committed(spark, f"{out}/{kind}", TELEMETRY[kind]) for kind in tables})


@query("stored_retention", "M5", V("clicks") + """
select event_id, event_time, short_code from clicks where event_time >= timestamp '2024-01-30 23:59:59' - interval 500 hour""")
def q_stored_retention(spark, sf):
    """Clicks stored by day, after days and a part of one have expired."""
    from linkstream.sources.retention import drop_expired, write_by_day
    path = scratch_path(spark, "clicks-by-day")
    write_by_day(FX.clicks(Tables(spark, sf)).select("event_id", "event_time", "short_code"), path, "event_time")
    drop_expired(spark, path, "event_time", FX.NOW, "500 HOURS")
    return spark.read.parquet(path).drop("day")
