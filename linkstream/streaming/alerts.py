"""Watermarked streams: trending top-N, sessions, bot alerts.

These are the only streams with event-time state; each sits behind a
watermark so state is dropped once a window can no longer change.  Rows
that arrive after their window closed are counted by Spark as
``numRowsDroppedByWatermark`` in the query progress (reported by
``dropped_by_watermark``), never silently.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BinaryType, IntegralType

from linkstream.constants import BOT_THRESHOLD, CLICK_WATERMARK, OUTCOME_GUARD_MISS
from linkstream.streaming.ingest import with_click_watermark


def stream_trending_counts(stream: DataFrame, size: str = "15 minutes", slide: str = "1 minute",
                           ts: str = "event_time", key: str = "short_code",
                           delay: str = CLICK_WATERMARK) -> DataFrame:
    return (with_click_watermark(stream, delay, ts)
                  .groupBy(F.window(ts, size, slide).alias("w"), key)
                  .agg(F.count(F.lit(1)).alias("clicks")))


def rank_closed_windows(n: int, out_path: str, key: str = "short_code"):
    """foreachBatch ranker: in append mode a window's final counts arrive in
    one batch, so ranking inside the batch is exact."""
    def step(batch: DataFrame, batch_id: int) -> None:
        w = Window.partitionBy("w").orderBy(F.col("clicks").desc(), F.col(key).asc())
        ranked = (batch.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)
                       .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                               key, "clicks", "rank"))
        ranked.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    return step


def stream_trending(stream: DataFrame, out_path: str, checkpoint: str, n: int = 10,
                    size: str = "15 minutes", slide: str = "1 minute",
                    trigger: dict | None = None) -> StreamingQuery:
    counts = stream_trending_counts(stream, size, slide)
    w = (counts.writeStream.outputMode("append").foreachBatch(rank_closed_windows(n, out_path))
               .option("checkpointLocation", checkpoint))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def stream_sessions(stream: DataFrame, key: str, gap: str, ts: str = "event_time",
                    delay: str = CLICK_WATERMARK) -> DataFrame:
    return (with_click_watermark(stream, delay, ts)
                  .groupBy(F.session_window(ts, gap).alias("s"), key)
                  .agg(F.count(F.lit(1)).alias("events"))
                  .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                          "events"))


def stream_bot_windowed(stream: DataFrame, key: str, threshold: int = BOT_THRESHOLD,
                        window: str = "1 minute", ts: str = "event_time",
                        delay: str = CLICK_WATERMARK) -> DataFrame:
    """Keys with more than ``threshold`` events in a minute (the stated rule)."""
    agg = (with_click_watermark(stream, delay, ts).groupBy(key, F.window(ts, window).alias("w"))
                 .agg(F.count(F.lit(1)).alias("events")))
    return (agg.where(F.col("events") > threshold)
               .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events"))


#: Groups of keys that ``stream_bot_lifetime`` counts together, fixed for a checkpoint.
LIFETIME_GROUPS = 2_048


def stream_bot_lifetime(stream: DataFrame, key: str, ts: str, threshold: int = BOT_THRESHOLD,
                        tiebreak: str | None = None, groups: int = LIFETIME_GROUPS) -> DataFrame:
    """Keyed lifetime count in value state; one alert per event past
    ``threshold`` (the snippet's behaviour).  State per key is one long.

    A call of Python costs milliseconds, so it counts the keys of a hash group,
    not of one key: a batch has ``groups`` calls at most.  Only keys that pass
    the threshold have their rows put in order.  ``key`` is of an atomic type.
    """
    cols = stream.columns
    order = [ts] + ([tiebreak] if tiebreak else [])
    # In pandas a null among integers makes them floats, so they travel as decimals.
    kinds = {f.name: "decimal(20,0)" if isinstance(f.dataType, IntegralType) else f.dataType for f in stream.schema}
    name = F.hex(key) if isinstance(stream.schema[key].dataType, BinaryType) else F.col(key).cast("string")
    rows = stream.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group"), name.alias("_key"),
                         *[F.col(c).cast(kinds[c]).alias(c) for c in cols])
    out_schema = rows.select(*cols, F.lit(0).cast("bigint").alias("count")).schema

    def step(k, pdfs, state):
        held = dict(zip(*state.get)) if state.exists else {}
        batch = pd.concat(list(pdfs), ignore_index=True)
        codes, names = pd.factorize(batch["_key"], use_na_sentinel=False)
        names = [n if isinstance(n, str) else None for n in names]
        before = np.array([held.get(n, 0) for n in names], dtype="int64")
        after = before + np.bincount(codes, minlength=len(names))
        held.update(zip(names, after.tolist()))
        state.update((list(held), list(held.values())))
        over = (after > threshold)[codes]
        if over.any():
            late = batch.loc[over, cols].assign(_code=codes[over]).sort_values(order, kind="stable")
            counts = before[late["_code"]] + late.groupby("_code").cumcount().to_numpy() + 1
            hit = counts > threshold
            yield late.loc[hit, cols].assign(count=counts[hit])

    alerts = rows.groupBy("_group").applyInPandasWithState(
        step, out_schema, "names array<string>, counts array<bigint>", "append", GroupStateTimeout.NoTimeout)
    return alerts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in stream.schema], "count")


def stream_time_to_first_click(created: DataFrame, clicks: DataFrame, within: str = "30 DAYS",
                               code: str = "short_code", delay: str = CLICK_WATERMARK) -> DataFrame:
    """Interval join of two streams: the first click on a code from its creation
    (key, timestamp) up to ``within`` after it.  A row comes out once the
    watermark says that no earlier click can follow; state on both sides is
    bounded by ``within``."""
    made = created.select(F.col("key").alias("_key"), F.col("timestamp").alias("created_at")).withWatermark("created_at", delay)
    used = clicks.select(code, "event_time").withWatermark("event_time", delay)
    pairs = used.join(made, (F.col(code) == F.col("_key")) & (F.col("event_time") >= F.col("created_at"))
                      & (F.col("event_time") <= F.col("created_at") + F.expr(f"INTERVAL {within}")))
    # As a number the click time carries no watermark, so the group's is the creation's.
    first = (pairs.select(code, "created_at", F.unix_micros("event_time").alias("_at"))
                  .groupBy(code, "created_at").agg(F.min("_at").alias("_at")))
    return first.select(code, "created_at", F.timestamp_micros("_at").alias("first_click"),
                        F.floor((F.col("_at") - F.unix_micros("created_at")) / 1_000_000).cast("bigint")
                         .alias("seconds_to_first_click"))


def stream_known_code_guard(requests: DataFrame, created: DataFrame, horizon: str = "40 DAYS", code: str = "short_code",
                            ts: str = "ts", delay: str = CLICK_WATERMARK) -> DataFrame:
    """The known-code guard on streams: each request with the creation of its
    code (``created_at``), or with the outcome of an unknown one.

    A left outer join of two streams.  A request waits until the watermark says
    that no creation up to its own time can follow; only then is its code
    unknown.  A creation is remembered for ``horizon``, which bounds the state.
    ``created`` (value, timestamp) has a row a code (see ``ingest.dedup_stream``).
    """
    made = created.select(F.col("value").alias("_code"), F.col("timestamp").alias("created_at")).withWatermark("created_at", delay)
    asked = with_click_watermark(requests, delay, ts)
    known = ((F.col(code) == F.col("_code")) & (F.col("created_at") <= F.col(ts))
             & (F.col("created_at") >= F.col(ts) - F.expr(f"INTERVAL {horizon}")))
    return asked.join(made, known, "leftOuter").select(
        *requests.columns, "created_at", F.when(F.col("created_at").isNull(), F.lit(OUTCOME_GUARD_MISS)).alias("outcome"))


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows dropped as too late by the stateful operators, over recent progress."""
    total = 0
    for p in query.recentProgress:
        for op in p.get("stateOperators", []) if isinstance(p, dict) else p.stateOperators:
            total += (op.get("numRowsDroppedByWatermark", 0) if isinstance(op, dict)
                      else op.numRowsDroppedByWatermark)
    return total
