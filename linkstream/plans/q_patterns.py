"""Registered queries: documented patterns."""

from __future__ import annotations

from linkstream.operators import patterns as PT
from linkstream.operators.rollup import hourly_rollup
from linkstream.plans.oracle_fixtures import with_views as V
from linkstream.plans.registry import query
from linkstream.sources import fixtures as FX
from linkstream.sources.tables import Tables


@query("hourly_avg", "A7", V("sensor_data") + """
select date_trunc('hour', timestamp) as hour, round(avg(temperature), 6) as avg_value from sensor_data
where sensor_id = 7 and timestamp >= timestamp '2024-01-30 23:59:59' - interval 24 hours group by all""")
def q_hourly_avg(spark, sf):
    return PT.hourly_avg(FX.sensor_data(Tables(spark, sf)), 7, FX.NOW)


@query("hourly_avg_week", "A7", V("sensor_data") + """
select date_trunc('hour', timestamp) as hour, round(avg(temperature), 6) as avg_value from sensor_data
where sensor_id = 7 and timestamp >= timestamp '2024-01-30 23:59:59' - interval 7 days group by all""")
def q_hourly_avg_week(spark, sf):
    return PT.hourly_avg(FX.sensor_data(Tables(spark, sf)), 7, FX.NOW, "7 DAYS")


@query("vwap", "A8", V("stock_trades") + """
select symbol, round(sum(price * volume) / nullif(sum(volume), 0), 6) as vwap from stock_trades
where timestamp >= timestamp '1995-01-01 00:00:00' group by symbol""")
def q_vwap(spark, sf):
    return PT.vwap(FX.stock_trades(Tables(spark, sf)), "1995-01-01 00:00:00")


@query("vwap_symbol", "A8, P11", V("stock_trades") + """
select symbol, round(sum(price * volume) / nullif(sum(volume), 0), 6) as vwap from stock_trades
where timestamp >= timestamp '1995-01-01 00:00:00' and symbol = 'S7' group by symbol""")
def q_vwap_symbol(spark, sf):
    return PT.vwap(FX.stock_trades(Tables(spark, sf)), "1995-01-01 00:00:00", "S7")


@query("top_products_by_revenue", "A9", V("user_events") + """
select product_id, revenue, row_number() over (order by revenue desc, product_id) as rank from (
  select product_id, round(sum(amount), 6) as revenue from user_events
  where event_type = 'purchase' and timestamp >= timestamp '2024-01-30 23:59:59' - interval 1 day
  group by product_id order by revenue desc, product_id limit 5)""")
def q_top_products(spark, sf):
    return PT.top_products_by_revenue(FX.user_events(Tables(spark, sf)), FX.NOW, 5)


@query("running_clicks", "W1", V("clicks") + """
select short_code, hour, clicks,
  cast(sum(clicks) over (partition by short_code order by hour rows between unbounded preceding and current row)
       as bigint) as running_clicks
from (select short_code, date_trunc('hour', event_time) as hour, count(*) as clicks from clicks group by all)""")
def q_running_clicks(spark, sf):
    return PT.running_clicks(hourly_rollup(FX.clicks(Tables(spark, sf))))


@query("rolling_avg", "W2", V("sensor_data") + """
select sensor_id, timestamp, round(s / n, 6) as rolling_avg from (
  select sensor_id, timestamp,
    sum(s) over (partition by sensor_id order by epoch(timestamp) range between 21600 preceding and current row) as s,
    sum(n) over (partition by sensor_id order by epoch(timestamp) range between 21600 preceding and current row) as n
  from (select sensor_id, timestamp, sum(temperature) as s, count(temperature) as n from sensor_data group by all))""")
def q_rolling_avg(spark, sf):
    return PT.rolling_avg(FX.sensor_data(Tables(spark, sf)), "sensor_id", "timestamp", "temperature", 6 * 3600)


@query("sessions", "W3", V("user_events") + """
select user_id, session_no, min(timestamp) as session_start, max(timestamp) as session_end, count(*) as events
from (select *, cast(sum(case when prev is null or epoch_us(timestamp) - epoch_us(prev) >= 1800000000 then 1 else 0 end)
        over (partition by user_id order by timestamp, product_id, event_type, amount
              rows between unbounded preceding and current row) as bigint) as session_no
      from (select *, lag(timestamp) over (partition by user_id order by timestamp, product_id, event_type, amount)
              as prev from user_events))
group by user_id, session_no""")
def q_sessions(spark, sf):
    ev = FX.user_events(Tables(spark, sf))
    return PT.sessions(ev, "user_id", "timestamp", 1800)


@query("trending_topn", "W5, R3", V("clicks") + """,
w as (select date_trunc('minute', event_time) - to_minutes(k) as window_start, short_code
      from clicks, range(15) r(k)),
c as (select window_start, window_start + interval 15 minute as window_end, short_code, count(*) as clicks
      from w group by all)
select * from (select *, row_number() over (partition by window_start order by clicks desc, short_code) as rank
  from c) where rank <= 10""")
def q_trending(spark, sf):
    return PT.trending_topn(FX.clicks(Tables(spark, sf)), "15 minutes", "1 minute", 10)


@query("bot_alerts_windowed", "R5a", V("redirect_requests") + """
select short_code, date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end,
  count(*) as events
from redirect_requests group by short_code, date_trunc('hour', ts) having count(*) > 2""")
def q_bot_windowed(spark, sf):
    return PT.windowed_alerts(FX.redirect_requests(Tables(spark, sf)), "short_code", "ts", 2, "1 hour")


@query("bot_alerts_lifetime", "R5b", V("redirect_requests") + """
select request_id, ts, short_code, cnt as count from (
  select *, count(*) over (partition by short_code order by ts, request_id
                           rows between unbounded preceding and current row) as cnt from redirect_requests)
where cnt > 60""")
def q_bot_lifetime(spark, sf):
    return PT.lifetime_alerts(FX.redirect_requests(Tables(spark, sf)), "short_code", "ts", 60, "request_id")


@query("funnel", "R11", V("user_events") + """,
s1 as (select user_id, min(timestamp) as step_1 from user_events where event_type = 'view' group by user_id),
s2 as (select s1.user_id, min(e.timestamp) as step_2 from s1 join user_events e
       on e.user_id = s1.user_id and e.event_type = 'click' and e.timestamp > s1.step_1 group by s1.user_id),
s3 as (select s2.user_id, min(e.timestamp) as step_3 from s2 join user_events e
       on e.user_id = s2.user_id and e.event_type = 'purchase' and e.timestamp > s2.step_2 group by s2.user_id)
select s1.user_id, step_1, step_2, step_3,
  cast(1 + (step_2 is not null)::int + (step_3 is not null)::int as int) as steps_completed
from s1 left join s2 using (user_id) left join s3 using (user_id)""")
def q_funnel(spark, sf):
    return PT.funnel(FX.user_events(Tables(spark, sf)), ["view", "click", "purchase"])


@query("time_to_first_click", "J9", V("created_events", "clicks") + """
select c.key as short_code, c.timestamp as created_at, min(k.event_time) as first_click,
  (epoch_us(min(k.event_time)) - epoch_us(c.timestamp)) // 1000000 as seconds_to_first_click
from created_events c join clicks k on k.short_code = c.key
 and k.event_time >= c.timestamp and k.event_time <= c.timestamp + interval 30 day
group by c.key, c.timestamp""")
def q_ttfc(spark, sf):
    t = Tables(spark, sf)
    return PT.time_to_first_click(FX.created_events(t), FX.clicks(t), "30 DAYS")


@query("match_pattern", "R11", V("user_events") + """,
bought as (select p.user_id, p.timestamp,
    (select max(c.timestamp) from user_events c where c.user_id = p.user_id and c.event_type = 'click' and c.timestamp < p.timestamp) as last_click,
    (select max(v.timestamp) from user_events v where v.user_id = p.user_id and v.event_type = 'view' and v.timestamp < p.timestamp) as last_view
  from user_events p where p.event_type = 'purchase'),
m as (select v.user_id, v.timestamp as match_start, min(b.timestamp) as match_end
  from user_events v join bought b on b.user_id = v.user_id and b.last_click > v.timestamp and (b.last_view is null or b.last_view < b.last_click)
  where v.event_type = 'view' group by v.user_id, v.timestamp)
select * from m where match_end <= match_start + interval 2 day""")
def q_match_pattern(spark, sf):
    """A view, clicks, and a purchase without another view since the last of these clicks."""
    from linkstream.operators.matching import Step, match_pattern
    steps = [Step("view"), Step("click", repeated=True), Step("purchase", without=("view",))]
    return match_pattern(FX.user_events(Tables(spark, sf)), steps, "2 DAYS")
