"""Registered queries: roll-ups and top links."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkstream.functions.timefns import recent
from linkstream.operators import rollup as R
from linkstream.operators import toplinks as TL
from linkstream.plans.oracle_fixtures import with_views as V
from linkstream.plans.registry import query
from linkstream.session import scratch_path
from linkstream.sources import fixtures as FX
from linkstream.sources.sinks import write_rollup
from linkstream.sources.tables import Tables
from linkstream.streaming import ingest as IN

_HOURLY_SQL = """hourly as (select date_trunc('hour', event_time) as hour, short_code, country_code,
  count(*) as total_clicks from clicks group by all)"""
_TOTALS_SQL = """totals as (select short_code, cast(sum(total_clicks) as bigint) as total_clicks
  from hourly group by short_code)"""
_LIVE_SQL = """live as (select id, long_url from url_mappings where long_url is not null and long_url <> '')"""


def rollup_of(spark, sf):
    return R.hourly_rollup(FX.clicks(Tables(spark, sf)))


@query("hourly_rollup", "A1", V("clicks") + """
select date_trunc('hour', event_time) as hour, short_code, country_code, count(*) as total_clicks
from clicks group by all""")
def q_hourly_rollup(spark, sf):
    return rollup_of(spark, sf)


@query("clicks_by_code", "A2", V("clicks") + ", " + _HOURLY_SQL + "\nselect * from (" +
       "select short_code, cast(sum(total_clicks) as bigint) as total_clicks from hourly group by short_code)")
def q_clicks_by_code(spark, sf):
    return R.clicks_by_code(rollup_of(spark, sf))


@query("compact_rollup", "A3", V("clicks") + """
select date_trunc('hour', event_time) as hour, short_code, country_code,
  cast(count(*) as bigint) as total_clicks from clicks group by all""")
def q_compact_rollup(spark, sf):
    # Partial rows as several ingest batches would leave them (one partial
    # per key and batch); compaction must give the single-pass roll-up.
    c = FX.clicks(Tables(spark, sf)).withColumn("batch_id", F.col("event_id") % 4)
    partials = (c.groupBy("batch_id", F.date_trunc("hour", "event_time").alias("hour"),
                          "short_code", "country_code")
                 .agg(F.count(F.lit(1)).alias("total_clicks")))
    return R.compact_rollup(partials)


@query("clicks_by_country", "A4", V("clicks") + """
select country_code, cast(count(*) as bigint) as total_clicks from clicks group by country_code""")
def q_clicks_by_country(spark, sf):
    return R.clicks_by_country(rollup_of(spark, sf))


@query("clicks_by_country_hour", "A4", V("clicks") + """
select date_trunc('hour', event_time) as hour, country_code, cast(count(*) as bigint) as total_clicks
from clicks group by all""")
def q_clicks_by_country_hour(spark, sf):
    return R.clicks_by_country(rollup_of(spark, sf), by_hour=True)


@query("totals_last_24h", "A5", V("clicks") + """
select short_code, cast(count(*) as bigint) as total_clicks from clicks
where date_trunc('hour', event_time) >= timestamp '2024-01-30 23:59:59' - interval 24 hours
group by short_code""")
def q_totals_last_24h(spark, sf):
    # A row's hour is at or before its time, so the bound holds for the rows
    # themselves, where it reaches the scan.
    clicks = recent(FX.clicks(Tables(spark, sf)), "event_time", FX.NOW, "24 HOURS")
    return R.totals_last_24h(R.hourly_rollup(clicks), "short_code", FX.NOW)


@query("stored_totals_last_24h", "A5, A3", V("clicks") + """
select short_code, cast(count(*) as bigint) as total_clicks from clicks
where date_trunc('hour', event_time) >= timestamp '2024-01-30 23:59:59' - interval 24 hours
group by short_code""")
def q_stored_totals_last_24h(spark, sf):
    """The same from the stored roll-up: two batches, the first one compacted."""
    out = scratch_path(spark, "rollup-24h")
    IN.init_rollup(spark, out)
    clicks, write = FX.clicks(Tables(spark, sf)), write_rollup(f"{out}/partials")
    write(clicks.where(F.col("event_id") % 2 == 0), 0)
    IN.compact_rollup_job(spark, out, 0)
    write(clicks.where(F.col("event_id") % 2 == 1), 1)
    return R.totals_last_24h(IN.read_rollup(spark, out, "2024-01-29 23:59:59"), "short_code", FX.NOW)


@query("created_per_hour", "A15", V("created_events") + """
select date_trunc('hour', timestamp) as hour, count(*) as created from created_events group by all""")
def q_created_per_hour(spark, sf):
    return R.created_per_hour(FX.created_events(Tables(spark, sf)))


@query("top_links", "T1", V("clicks") + ", " + _HOURLY_SQL + ", " + _TOTALS_SQL + """
select short_code, total_clicks, row_number() over (order by total_clicks desc, short_code) as rank
from (select * from totals order by total_clicks desc, short_code limit 10)""")
def q_top_links(spark, sf):
    return TL.top_links(rollup_of(spark, sf), 10)


@query("top_links_enriched", "J1", V("clicks", "url_mappings") + ", " + _HOURLY_SQL + ", " + _TOTALS_SQL
       + ", " + _LIVE_SQL + """,
top as (select * from totals order by total_clicks desc, short_code limit 10)
select t.short_code, l.long_url, t.total_clicks,
  row_number() over (order by t.total_clicks desc, t.short_code) as rank
from top t join live l on t.short_code = l.id""")
def q_top_links_enriched(spark, sf):
    t = Tables(spark, sf)
    return TL.top_links_enriched(R.hourly_rollup(FX.clicks(t)), FX.url_mappings(t), 10)


@query("top_links_enriched_before_limit", "J1", V("clicks", "url_mappings") + ", " + _HOURLY_SQL + ", "
       + _TOTALS_SQL + ", " + _LIVE_SQL + """,
top as (select t.short_code, l.long_url, t.total_clicks from totals t join live l on t.short_code = l.id
        order by t.total_clicks desc, t.short_code limit 10)
select *, row_number() over (order by total_clicks desc, short_code) as rank from top""")
def q_top_links_before(spark, sf):
    t = Tables(spark, sf)
    return TL.top_links_enriched(R.hourly_rollup(FX.clicks(t)), FX.url_mappings(t), 10, "before_limit")


@query("top_links_page2", "T2", V("clicks", "url_mappings") + ", " + _HOURLY_SQL + ", " + _TOTALS_SQL
       + ", " + _LIVE_SQL + """,
pg as (select * from totals order by total_clicks desc, short_code limit 10 offset 10),
full_page as (select count(*) = 10 as has_next from pg)
select p.short_code, l.long_url, p.total_clicks,
  10 + row_number() over (order by p.total_clicks desc, p.short_code) as rank, f.has_next
from pg p join live l on p.short_code = l.id cross join full_page f""")
def q_top_links_page(spark, sf):
    t = Tables(spark, sf)
    return TL.top_links_page(R.hourly_rollup(FX.clicks(t)), FX.url_mappings(t), page=2, limit=10)


@query("orphan_clicks", "J2", V("clicks", "url_mappings") + ", " + _HOURLY_SQL + ", " + _TOTALS_SQL
       + ", " + _LIVE_SQL + """
select * from totals t where not exists (select 1 from live l where l.id = t.short_code)""")
def q_orphan_clicks(spark, sf):
    t = Tables(spark, sf)
    return TL.orphan_clicks(R.hourly_rollup(FX.clicks(t)), FX.url_mappings(t))


@query("top_links_json", "S10", V("clicks", "url_mappings") + ", " + _HOURLY_SQL + ", " + _TOTALS_SQL
       + ", " + _LIVE_SQL + """,
top as (select * from totals order by total_clicks desc, short_code limit 10),
e as (select t.short_code, l.long_url, t.total_clicks from top t join live l on t.short_code = l.id)
select '{"top_links":[' || coalesce(string_agg(json_object('short_code', short_code, 'long_url', long_url,
  'total_clicks', total_clicks)::varchar, ',' order by total_clicks desc, short_code), '') || ']}' as json from e""")
def q_top_links_json(spark, sf):
    t = Tables(spark, sf)
    return TL.top_links_json(TL.top_links_enriched(R.hourly_rollup(FX.clicks(t)), FX.url_mappings(t), 10))


@query("top_links_enriched_stored", "J1, S7", V("clicks", "url_mappings") + ", " + _HOURLY_SQL + ", " + _TOTALS_SQL
       + ", " + _LIVE_SQL + """,
top as (select * from totals order by total_clicks desc, short_code limit 10)
select t.short_code, l.long_url, t.total_clicks,
  row_number() over (order by t.total_clicks desc, t.short_code) as rank
from top t join live l on t.short_code = l.id""")
def q_top_links_stored(spark, sf):
    """Top links against a stored, id-bucketed link table: dynamic partition
    pruning reads only the buckets of the ranked codes."""
    from linkstream.plans.joins import LINK_BUCKETS
    from linkstream.session import scratch_path
    from linkstream.sources.sinks import read_links, write_links
    t = Tables(spark, sf)
    path = scratch_path(spark, "links")
    write_links(FX.url_mappings(t), path, LINK_BUCKETS)
    links = read_links(spark, path)
    return TL.top_links_enriched(R.hourly_rollup(FX.clicks(t)), links, 10, link_buckets=LINK_BUCKETS)
