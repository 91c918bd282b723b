"""Registered queries: redirect resolution."""

from __future__ import annotations

from linkstream.operators import resolve as RS
from linkstream.plans.oracle_fixtures import with_views as V
from linkstream.plans.registry import query
from linkstream.sources import fixtures as FX
from linkstream.sources.tables import Tables

_RESOLVED = V("redirect_requests", "created_events", "cache_entries") + """,
known as (select distinct value as short_code from created_events),
res as (
  select r.request_id, r.ts, r.short_code,
    case when coalesce(r.short_code, '') = '' then 'missing_short_code'
         when k.short_code is null then 'url_not_found_bloom'
         when c.long_url is not null then 'redis'
         when m.long_url is not null and m.long_url <> '' then 'db_stale'
         else 'url_not_found_db' end as source,
    c.long_url as cache_url, m.long_url as table_url
  from redirect_requests r
  left join known k on k.short_code = r.short_code
  left join cache_entries c on c.short_code = r.short_code and r.ts < c.expires_at
  left join url_mappings m on m.id = r.short_code),
resolved as (select request_id, ts, short_code, source,
  case source when 'missing_short_code' then 400 when 'redis' then 302 when 'db_stale' then 302 else 404 end as status,
  case source when 'redis' then cache_url when 'db_stale' then table_url end as long_url from res)
"""


def _resolved(spark, sf, miss_error=False):
    t = Tables(spark, sf)
    known = RS.known_codes(FX.created_events(t))
    return RS.resolve_redirects(FX.redirect_requests(t), known, FX.cache_entries(t), FX.url_mappings(t),
                                count_miss_as_error=miss_error)


@query("known_codes", "U1", V("created_events", "url_mappings") + """
select distinct short_code from (select value as short_code from created_events
  union all select id from url_mappings)""")
def q_known_codes(spark, sf):
    t = Tables(spark, sf)
    resolved = FX.url_mappings(t).withColumnRenamed("id", "short_code")
    return RS.known_codes(FX.created_events(t), resolved)


@query("guard_false_positives", "U2", V("created_events", "url_mappings") + """
select distinct value as short_code from created_events where value not in (select id from url_mappings)""")
def q_false_positives(spark, sf):
    t = Tables(spark, sf)
    return RS.guard_false_positives(RS.known_codes(FX.created_events(t)), FX.url_mappings(t))


@query("known_code_guard_rejects", "J4", V("redirect_requests", "created_events") + """
select r.*, 'url_not_found_bloom' as outcome from redirect_requests r
where r.short_code not in (select value from created_events)""")
def q_guard(spark, sf):
    t = Tables(spark, sf)
    _, rejected = RS.known_code_guard(FX.redirect_requests(t), RS.known_codes(FX.created_events(t)))
    return rejected


@query("resolve_redirects", "J5", _RESOLVED + "select * from resolved")
def q_resolve(spark, sf):
    return _resolved(spark, sf).select("request_id", "ts", "short_code", "source", "status", "long_url")


@query("resolve_redirects_outcomes", "J5", _RESOLVED + """
select source, status, count(*) as requests,
  cast(sum(case when source in ('db_stale', 'url_not_found_db') then 1 else 0 end) as bigint) as cache_errors
from resolved group by all""")
def q_resolve_outcomes(spark, sf):
    from pyspark.sql import functions as F
    r = _resolved(spark, sf, miss_error=True)
    return r.groupBy("source", "status").agg(F.count(F.lit(1)).alias("requests"),
                                             F.count("cache_error").alias("cache_errors"))


def _as_of_sql(seconds):
    return V("redirect_requests", "created_events", "cache_entries", "link_changes") + f""",
state as (select id, commit_ts + interval {seconds} second as seen_at, arg_max(op, seq) as op, arg_max(long_url, seq) as long_url
          from link_changes group by id, commit_ts),
known as (select value as short_code, min(timestamp) as since from created_events group by value),
seen as (select r.request_id, r.ts, r.short_code, case when s.op <> 'delete' then s.long_url end as table_url
         from redirect_requests r asof left join state s on r.short_code = s.id and r.ts >= s.seen_at),
res as (select s.*, c.long_url as cache_url,
    case when k.short_code is null then 'url_not_found_bloom' when c.long_url is not null then 'redis'
         when table_url is not null and table_url <> '' then 'db_stale' else 'url_not_found_db' end as source
  from seen s left join known k on k.short_code = s.short_code and k.since <= s.ts
  left join cache_entries c on c.short_code = s.short_code and s.ts < c.expires_at)
select request_id, ts, short_code, source, case source when 'redis' then 302 when 'db_stale' then 302 else 404 end as status,
  case source when 'redis' then cache_url when 'db_stale' then table_url end as long_url from res"""


def _as_of(spark, sf, staleness):
    t = Tables(spark, sf)
    out = RS.resolve_redirects_as_of(FX.redirect_requests(t), FX.created_events(t), FX.cache_entries(t), FX.link_changes(t), staleness)
    return out.select("request_id", "ts", "short_code", "source", "status", "long_url")


@query("resolve_redirects_as_of", "J3, J5", _as_of_sql(15))
def q_resolve_as_of(spark, sf):
    """Each request sees the table as it was 15 seconds before it."""
    return _as_of(spark, sf, "15 seconds")


@query("resolve_redirects_strong", "J3, J5", _as_of_sql(0))
def q_resolve_strong(spark, sf):
    return _as_of(spark, sf, "0 seconds")


@query("redirect_clicks", "J5", _RESOLVED + """
select ts as event_time, short_code, 'Unknown' as country_code from resolved where status = 302""")
def q_redirect_clicks(spark, sf):
    return RS.clicks_from_redirects(_resolved(spark, sf))


@query("cache_hit_ratio", "A11", _RESOLVED + """
select date_trunc('hour', ts) as bucket,
  cast(sum(case when source = 'redis' then 1 else 0 end) as bigint) as hits,
  cast(sum(case when source in ('db_stale', 'url_not_found_db') then 1 else 0 end) as bigint) as misses,
  round(cast(sum(case when source = 'redis' then 1 else 0 end) as double)
        / nullif(sum(case when source in ('redis', 'db_stale', 'url_not_found_db') then 1 else 0 end), 0), 9)
    as hit_ratio
from resolved group by all""")
def q_cache_hit_ratio(spark, sf):
    return RS.cache_hit_ratio(_resolved(spark, sf), "hour")


@query("rate_limit_audit", "A14", V("redirect_requests") + """
select short_code, date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end,
  count(*) as requests, count(*) - 3 as excess
from redirect_requests group by short_code, date_trunc('day', ts) having count(*) > 3""")
def q_rate_limit(spark, sf):
    return RS.rate_limit_audit(FX.redirect_requests(Tables(spark, sf)), ["short_code"], 3, "1 day")


@query("rate_limit_audit_global", "A14", V("redirect_requests") + """
select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end,
  count(*) as requests, count(*) - 15 as excess
from redirect_requests group by date_trunc('hour', ts) having count(*) > 15""")
def q_rate_limit_global(spark, sf):
    return RS.rate_limit_audit(FX.redirect_requests(Tables(spark, sf)), [], 15, "1 hour")
