"""Registered queries: click parsing and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkstream.functions import text as T
from linkstream.operators import clicks as C
from linkstream.plans.oracle_fixtures import with_views as V
from linkstream.plans.registry import query
from linkstream.sources import fixtures as FX
from linkstream.sources.tables import Tables

# RFC 3339 text -> UTC timestamp, written out by hand for the oracle.
_PARSED = V("click_json") + """,
j as (select event_id, value, json_valid(value) as ok,
        case when json_valid(value) then json_extract_string(value, '$.short_code') end as short_code,
        case when json_valid(value) then json_extract_string(value, '$.timestamp') end as ts_s,
        case when json_valid(value) then json_extract_string(value, '$.country') end as country,
        case when json_valid(value) then json_extract_string(value, '$.user_agent') end as user_agent from click_json),
p as (select *,
  cast(replace(substr(ts_s, 1, 19), 'T', ' ') as timestamp)
   - case when ts_s like '%Z' then interval 0 minute
          else (case when substr(ts_s, 20, 1) = '-' then -1 else 1 end)
               * (to_hours(cast(substr(ts_s, 21, 2) as int)) + to_minutes(cast(substr(ts_s, 24, 2) as int))) end
   as event_time,
  coalesce(nullif(country, ''), 'Unknown') as country_code,
  case when not ok then 'malformed_json' end as reject_reason,
  case when not ok then 'reject' when regexp_matches(user_agent, '(?i)(bot|crawler|spider)') then 'bot'
       else 'main' end as route
  from j)
"""


@query("parse_clicks", "S2", _PARSED + """
select event_id, event_time, short_code, country_code, user_agent from p where ok""")
def q_parse_clicks(spark, sf):
    good, _ = C.parse_clicks(FX.click_json(Tables(spark, sf)))
    return good


@query("parse_clicks_rejects", "S2", _PARSED + """
select event_id, value, reject_reason from p where not ok""")
def q_parse_rejects(spark, sf):
    _, bad = C.parse_clicks(FX.click_json(Tables(spark, sf)))
    return bad


@query("rfc3339_to_ts", "P2", _PARSED + """
select event_id, ts_s, event_time from p where ok""")
def q_rfc3339(spark, sf):
    from linkstream.functions.timefns import rfc3339_to_ts
    cj = FX.click_json(Tables(spark, sf))
    ts_s = F.get_json_object("value", "$.timestamp")
    return cj.where(ts_s.isNotNull()).select("event_id", ts_s.alias("ts_s"), rfc3339_to_ts(ts_s).alias("event_time"))


@query("project_click", "P1", V("clicks") + """
select event_time, short_code, country_code from clicks""")
def q_project_click(spark, sf):
    c = FX.clicks(Tables(spark, sf)).withColumnRenamed("country_code", "country")
    return C.project_click(c)


@query("split_clicks", "R6", _PARSED + "select event_id, route from p")
def q_split_clicks(spark, sf):
    return C.route_clicks(FX.click_json(Tables(spark, sf))).select("event_id", "route")


@query("split_clicks_bots", "R6", _PARSED + """
select event_id, event_time, short_code, country_code, user_agent from p where route = 'bot'""")
def q_split_bots(spark, sf):
    _, bots, _ = C.split_clicks(FX.click_json(Tables(spark, sf)))
    return bots


@query("dedup_clicks", "R9", V("clicks") + "select * from clicks")
def q_dedup_clicks(spark, sf):
    c = FX.clicks(Tables(spark, sf))
    redelivered = c.unionByName(c)  # every event delivered twice (at-least-once)
    return C.dedup_clicks(redelivered, ["event_id"])


@query("valid_codes", "P4", V("redirect_requests") + """
select * from redirect_requests where regexp_matches(short_code, '^[A-Za-z0-9_-]+$')""")
def q_valid_codes(spark, sf):
    return C.valid_code_filter(FX.redirect_requests(Tables(spark, sf)))


@query("valid_codes_strict", "P4", V("redirect_requests") + """
select * from redirect_requests where regexp_matches(short_code, '^[A-Za-z0-9]{7,12}$')""")
def q_valid_codes_strict(spark, sf):
    return C.valid_code_filter(FX.redirect_requests(Tables(spark, sf)), "^[A-Za-z0-9]{7,12}$")


@query("publish_clicks", "S4", V("clicks") + """
select event_id, cast(null as varchar) as key,
  json_object('short_code', short_code, 'timestamp', strftime(event_time, '%Y-%m-%dT%H:%M:%SZ'),
              'country', country_code, 'user_agent', user_agent)::varchar as value from clicks""")
def q_publish_clicks(spark, sf):
    return C.publish_clicks(FX.clicks(Tables(spark, sf)), keep=("event_id",))


@query("publish_created", "S5", V("url_mappings") + "select id as key, id as value from url_mappings")
def q_publish_created(spark, sf):
    return C.publish_created(FX.url_mappings(Tables(spark, sf)))


@query("dedup_created", "R9", V("url_mappings") + "select distinct id as key, id as value from url_mappings")
def q_dedup_created(spark, sf):
    t = Tables(spark, sf)
    pub = C.publish_created(FX.url_mappings(t))
    return C.dedup_created(pub.unionByName(pub))  # two change-feed replicas emit each record


@query("valid_event_types", "H18", """
select event_id, event_type, event_type in ('view', 'click', 'purchase') as valid from events""")
def q_valid_enum(spark, sf):
    from linkstream.functions.text import valid_enum
    e = Tables(spark, sf)("events")
    return e.select("event_id", "event_type", valid_enum("event_type", ["view", "click", "purchase"]).alias("valid"))


@query("replace_time_mark", "H3", V("click_json") + """
select event_id, replace(replace(value, 'T', ' '), '.', ',') as value from click_json""")
def q_replace(spark, sf):
    """Literal replacement: the dot stands for itself only."""
    value = T.replace_literal(T.replace_literal("value", "T", " "), ".", ",")
    return FX.click_json(Tables(spark, sf)).select("event_id", value.alias("value"))
