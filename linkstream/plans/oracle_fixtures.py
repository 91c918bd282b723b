"""DuckDB SQL of the stand-in views, for the oracle queries.

Same rules as ``linkstream.sources.fixtures`` written independently in
SQL; oracle queries inline the views they need as CTEs.
"""

from __future__ import annotations

FIXTURE_SQL: dict[str, str] = {
    "clicks": """
select event_id, ts as event_time, lpad(cast(user_id as varchar(20)),11,'0') as short_code,
  coalesce(case when event_id % 10 = 0 then null
           else concat('C', lpad(cast(event_id % 25 as varchar(20)),2,'0')) end,'Unknown') as country_code,
  case when event_id % 20 = 0 then 'bot/1.0' else 'Mozilla/5.0' end as user_agent
from events where event_type = 'click'""",
    "click_json": """
select event_id, case when event_id % 50 = 0 then '{oops' else concat('{"short_code":"', short_code,
  '","timestamp":"', replace(cast(date_trunc('second', event_time) as varchar(30)),' ','T'),
  case when event_id % 3 = 0 then '+05:30' else 'Z' end,
  '","country":"', country_code, '","user_agent":"', user_agent, '"}') end as value
from clicks""",
    "url_mappings": """
select lpad(cast(page_id as varchar(20)),11,'0') as id, url as long_url,
  case when page_id % 4 = 0 then null else concat('user', cast(page_id % 20 as varchar(20))) end as user_id,
  timestamp '2024-01-01 00:00:00' + interval '1' minute * page_id as created_at
from pages where page_id % 7 <> 3""",
    "link_mutations": """
select lpad(cast(o_custkey as varchar(20)),11,'0') as id,
  case o_orderstatus when 'O' then 'insert' when 'F' then 'update' else 'delete' end as op,
  concat('https://example.com/', cast(o_orderkey as varchar(20))) as long_url,
  concat('user', cast((o_custkey + case when o_orderkey % 9 = 0 then 1 else 0 end) % 20 as varchar(20))) as user_id,
  o_orderdate as commit_ts, o_orderkey as seq from orders""",
    "link_changes": """
select lpad(cast(o_custkey as varchar(20)),11,'0') as id,
  case o_orderkey % 5 when 0 then 'delete' when 1 then 'update' else 'insert' end as op,
  concat('https://example.com/', cast(o_orderkey as varchar(20))) as long_url,
  concat('user', cast(o_custkey % 20 as varchar(20))) as user_id,
  timestamp '2024-01-01 00:00:00' + interval '1' second * ((o_orderkey * 7919) % 2592000) as commit_ts, o_orderkey as seq from orders""",
    "redirect_requests": """
select event_id as request_id, ts, case when event_id % 13 = 0 then concat('zz', cast(event_id as varchar(20)))
  else lpad(cast(user_id as varchar(20)),11,'0') end as short_code from events""",
    "cache_entries": """
select id as short_code, long_url, timestamp '2024-01-01 00:00:00' + to_days(cast(cast(id as bigint) % 28 + 1 as integer)) as expires_at
from url_mappings where substr(id, 11, 1) in ('0','3','6','9')""",
    "metric_points": """
select ts, event_type as service, 'http_requests_total' as name,
  case when event_id % 2 = 0 then 'GET' else 'POST' end as method,
  case when event_type = 'error' then 500 else 302 end as status_code, value / 1000 as duration,
  case when event_id % 3 = 0 then '/shorten' else '/:code' end as path,
  case when event_type = 'error' then case when event_id % 2 = 0 then 'url_not_found_bloom' else 'url_not_found_db' end end as reason,
  cast(event_id % 4 + 1 as bigint) as amount from events""",
    "app_logs": """
select ts as timestamp, concat('svc', cast(user_id % 5 as varchar(20))) as service_name,
  case when event_type = 'error' then 'ERROR' else 'INFO' end as level,
  regexp_extract(props, '[0-9]+', 0) as attr_k, event_id % 150 as trace_id from events""",
    "sensor_data": """
select ts as timestamp, user_id as sensor_id, value as temperature from events""",
    "stock_trades": """
select l_shipdate as timestamp, concat('S', cast(l_partkey % 50 as varchar(20))) as symbol,
  l_extendedprice / l_quantity as price, l_quantity as volume from lineitem""",
    "user_events": """
select ts as timestamp, user_id, event_type, cast(regexp_extract(props, '[0-9]+', 0) as bigint) as product_id,
  value as amount from events where event_type in ('view','click','purchase')""",
    "spans": """
select conv_id as trace_id, turn as span_id, case when turn = 0 then null else turn - 1 end as parent_span_id,
  role as service,
  timestamp '2024-01-01 00:00:00' + interval '1' minute * conv_id + interval '1' second * turn as start_ts,
  cast(length(text) as bigint) as duration_ms,
  case when (conv_id + turn) % 11 = 0 then 'ERROR' else 'OK' end as status from conversations""",
    "shorten_requests": """
select page_id as request_id,
  case when page_id % 11 = 0 then 'invalid json'
       else json_object('long_url', case when page_id % 13 = 0 then '' else url end,
                        'custom_slug', case when page_id % 5 = 0 then concat('s', cast(page_id as varchar)) else '' end)::varchar
  end as body,
  case when page_id % 4 = 0 then null else concat('user', cast(page_id % 20 as varchar(20))) end as user_id
from pages""",
    "created_events": """
select lpad(cast(page_id as varchar(20)),11,'0') as key, lpad(cast(page_id as varchar(20)),11,'0') as value,
  timestamp '2024-01-01 00:00:00' + interval '1' minute * page_id as timestamp from pages""",
}

_DEPS = {
    "click_json": ["clicks"],
    "cache_entries": ["url_mappings"],
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH v1 AS (...), v2 AS (...)`` for the named views (+ dependencies)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(f"{n} as ({FIXTURE_SQL[n]})" for n in order) + "\n"
