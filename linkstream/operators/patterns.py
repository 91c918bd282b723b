"""Documented analytics patterns: hourly averages, VWAP, top products,
running and rolling figures, sessions, trending top-N, funnels,
time to first click.

Scale notes per operator:

* ``rolling_avg``: rows are pre-aggregated per (key, ts); the range frame
  then runs inside (key, time chunk) where each chunk also receives a copy
  of the previous chunk (chunk width >= span), so a hot key is split
  across many tasks and the result is still exact.
* ``sessions``, lifetime counts, ``funnel`` and ``time_to_first_click`` are
  ordered scans that cut every key into ranges of rows (``plans.scan``).
* ``trending_topn``: ``row_number() <= n`` per window is planned as a
  WindowGroupLimit, which keeps only n rows per window on the map side.
  Counts per slice come first, so only they are spread over the windows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkstream.functions.timefns import recent, since, start_of_hour
from linkstream.plans.joins import bounded
from linkstream.plans.scan import PART, POS, ordered, scan_last, scan_sum


def hourly_avg(readings: DataFrame, sensor: int, now: str, window: str = "24 HOURS",
               value: str = "temperature") -> DataFrame:
    r = recent(readings.where(F.col("sensor_id") == F.lit(sensor)), "timestamp", now, window)
    return (r.groupBy(start_of_hour("timestamp").alias("hour"))
             .agg(F.round(F.avg(value), 6).alias("avg_value")).orderBy("hour"))


def vwap(trades: DataFrame, since_ts: str, symbol: str | None = None) -> DataFrame:
    t = since(trades, "timestamp", since_ts)
    if symbol is not None:
        t = t.where(F.col("symbol") == F.lit(symbol))
    agg = t.groupBy("symbol").agg(F.sum(F.col("price") * F.col("volume")).alias("pv"),
                                  F.sum("volume").alias("v"))
    return agg.select("symbol", F.round(F.try_divide("pv", "v"), 6).alias("vwap"))


def top_products_by_revenue(events: DataFrame, now: str, n: int = 5, window: str = "1 DAY") -> DataFrame:
    p = recent(events.where(F.col("event_type") == "purchase"), "timestamp", now, window)
    totals = p.groupBy("product_id").agg(F.round(F.sum("amount"), 6).alias("revenue"))
    order = [F.col("revenue").desc(), F.col("product_id").asc()]
    top = totals.orderBy(*order).limit(bounded(n))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # <= n rows


def running_clicks(rollup: DataFrame) -> DataFrame:
    """Per code and hour: clicks and running total.  Groups are bounded by the
    number of hours, since the rollup holds one row per (hour, code, country)."""
    per_hour = rollup.groupBy("short_code", "hour").agg(F.sum("total_clicks").cast("bigint").alias("clicks"))
    w = Window.partitionBy("short_code").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return per_hour.withColumn("running_clicks", F.sum("clicks").over(w).cast("bigint"))


def rolling_avg(df: DataFrame, key: str, ts: str, value: str, span_seconds: int,
                chunk_seconds: int | None = None) -> DataFrame:
    """Average of ``value`` over ``[t - span, t]`` per key at every distinct ``t``."""
    chunk = max(chunk_seconds or 0, span_seconds, 1)
    pre = (df.groupBy(key, ts).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
             .withColumn("_e", F.unix_micros(ts)))
    pre = pre.withColumn("_own", F.floor(F.col("_e") / (chunk * 1_000_000)))
    # Each row also serves the next chunk, whose frames reach back into it.
    copies = pre.withColumn("_part", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(key, "_part").orderBy("_e").rangeBetween(-span_seconds * 1_000_000, 0)
    rolled = copies.select(key, ts, "_own", "_part",
                           F.sum("_s").over(w).alias("_ws"), F.sum("_n").over(w).alias("_wn"))
    return (rolled.where(F.col("_own") == F.col("_part"))
                  .select(key, ts, F.round(F.try_divide("_ws", F.col("_wn").cast("double")), 6).alias("rolling_avg")))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, tiebreak: str | None = None) -> DataFrame:
    """Gap-based sessions: a new session starts when the time since the
    key's previous event reaches the gap.  -> one row per (key, session)."""
    order = [ts] + ([tiebreak] if tiebreak else [])
    # Same rule as session_window: events [t, t + gap) that overlap merge,
    # so an event exactly ``gap`` after the previous one starts a session.
    new = F.col("_prev").isNull() | (F.unix_micros(ts) - F.unix_micros("_prev") >= F.lit(gap_seconds * 1_000_000))
    e = scan_last(ordered(events.select(key, *order), [key], order), [key], F.col(ts), "_prev")
    e = scan_sum(e, [key], new.cast("int"), "session_no")
    return (e.groupBy(key, "session_no")
             .agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"),
                  F.count(F.lit(1)).alias("events")))


def _micros(span: str) -> int:
    return pd.Timedelta(span) // pd.Timedelta(microseconds=1)


def trending_topn(clicks: DataFrame, size: str = "15 minutes", slide: str = "1 minute", n: int = 10,
                  ts: str = "event_time", key: str = "short_code") -> DataFrame:
    """Top ``n`` keys of every sliding window.  Clicks are counted per slice
    first (slices divide both ``size`` and ``slide``, so no slice crosses the
    edge of a window); only these counts are spread over the windows."""
    piece = f"{math.gcd(_micros(size), _micros(slide))} microseconds"
    sliced = (clicks.groupBy(F.window(ts, piece).alias("_slice"), key).agg(F.count(F.lit(1)).alias("_n"))
                    .select(F.col("_slice.start").alias("_at"), key, "_n"))
    counts = sliced.groupBy(F.window("_at", size, slide).alias("w"), key).agg(F.sum("_n").alias("clicks"))
    w = Window.partitionBy("w").orderBy(F.col("clicks").desc(), F.col(key).asc())
    ranked = (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                    .withColumn("rank", F.col("rank").cast("bigint")))
    return ranked.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                         key, "clicks", "rank")


def lifetime_alerts(events: DataFrame, key: str, ts: str, threshold: int, tiebreak: str | None = None) -> DataFrame:
    """Keyed lifetime count; one alert per event past ``threshold``."""
    order = [ts] + ([tiebreak] if tiebreak else [])
    c = scan_sum(ordered(events, [key], order), [key], F.lit(1), "count")
    return c.where(F.col("count") > threshold).drop(POS, PART)


def windowed_alerts(events: DataFrame, key: str, ts: str, threshold: int, window: str = "1 minute") -> DataFrame:
    """Keys with more than ``threshold`` events in a tumbling window."""
    agg = events.groupBy(key, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return (agg.where(F.col("events") > threshold)
               .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events"))


def funnel(events: DataFrame, steps: list[str], key: str = "user_id", ts: str = "timestamp",
           kind: str = "event_type") -> DataFrame:
    """Per key, the time of each step reached in order: step k is the first
    event of kind ``steps[k]`` strictly after step k-1.

    Scans run from the last step to the first: each event learns the times of
    the steps after it.  A key's events of one time are one row, so "next" is
    strictly after.  Events without key take no part.
    """
    last = len(steps) - 1
    flags = [F.max(F.col(kind) == s).alias(f"_is{i}") for i, s in enumerate(steps)]
    rows = (events.where(F.col(kind).isin(steps) & F.col(key).isNotNull() & F.col(ts).isNotNull())
                  .groupBy(key, ts).agg(*flags))
    rows = ordered(rows, [key], [ts])
    path = F.array(F.col(ts))
    for i in range(last, 0, -1):
        rows = scan_last(rows, [key], F.when(F.col(f"_is{i}"), path), f"_after{i}", "next")
        here, after = F.array(F.col(ts)), F.col(f"_after{i}")
        path = F.when(after.isNull(), here).otherwise(F.concat(here, after))
    first = (rows.where("_is0").groupBy(key).agg(F.min_by(path, F.col(ts)).alias("_path")))
    return first.select(key, *[F.get("_path", F.lit(i)).alias(f"step_{i + 1}") for i in range(len(steps))],
                        F.size("_path").alias("steps_completed"))


def time_to_first_click(created: DataFrame, clicks: DataFrame, within: str = "30 DAYS",
                        code: str = "short_code") -> DataFrame:
    """First click on each created code within ``within`` of its creation.

    Creations and clicks are one ordered log per code; each creation looks for
    the next click (one at the same time counts), so a code with a third of all
    clicks is cut into ranges like the rest.
    """
    log = (created.select(F.col("key").alias(code), F.col("timestamp").alias("event_time"), F.lit(0).alias("_kind"))
                  .unionByName(clicks.select(code, "event_time").withColumn("_kind", F.lit(1)))
                  .where(F.col(code).isNotNull() & F.col("event_time").isNotNull())
                  .distinct())
    log = scan_last(ordered(log, [code], ["event_time", "_kind"]), [code],
                    F.when(F.col("_kind") == 1, F.col("event_time")), "first_click", "next")
    first = (log.where((F.col("_kind") == 0)
                       & (F.col("first_click") <= F.col("event_time") + F.expr(f"INTERVAL {within}")))
                .select(code, F.col("event_time").alias("created_at"), "first_click"))
    return first.withColumn("seconds_to_first_click",
                            F.floor((F.unix_micros("first_click") - F.unix_micros("created_at")) / 1_000_000).cast("bigint"))
