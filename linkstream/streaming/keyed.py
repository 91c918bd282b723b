"""Keyed processors with state and timers (``transformWithState``).

State lives in the RocksDB state store, one entry a key, or a group of keys and an
open period; rows are read one at a time, so a key that holds a large part of a
batch costs time in one task but no memory.  Spark's default store cannot hold
such state: start these streams in a session of ``get_spark`` or inside
``session.rocksdb_state``.  What a processor emits does not depend on the order
of the rows inside a batch.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from linkstream.constants import BOT_THRESHOLD, CACHE_TTL, CLICK_WATERMARK, OUTCOME_CACHE_HIT, OUTCOME_TABLE_HIT, OUTCOME_TABLE_MISS
from linkstream.streaming.ingest import with_click_watermark


#: Groups of keys that ``stream_bot_timers`` counts together, fixed for a checkpoint.
TIMER_GROUPS = 512


def stream_bot_timers(stream: DataFrame, key: str, ts: str = "event_time", threshold: int = BOT_THRESHOLD,
                      period_seconds: int = 60, delay: str = CLICK_WATERMARK, groups: int = TIMER_GROUPS) -> DataFrame:
    """Keys with more than ``threshold`` events in a period (a minute).

    -> (key, window_start, window_end, kind, events).  A period that passes the
    threshold is reported at once (``crossed``, with the event that did it) and
    again with its final count when its timer fires (``closed``): the timer is
    set to the end of the period, fires when the watermark has passed it, and
    drops the period's state.  Rows later than the watermark are dropped.

    A step in the state costs a message to the executor, so the keys of a hash
    group share one entry and one timer a period.
    """
    period, column = period_seconds * 1000, key
    kind = stream.schema[key].dataType
    out = StructType([StructField(key, kind), StructField("_start", LongType()),
                      StructField("kind", StringType()), StructField("events", LongType())])
    held = StructType([StructField("keys", ArrayType(kind)), StructField("n", ArrayType(LongType()))])
    alert = Row(*out.names)

    class Periods(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.counts = handle.getMapState("counts", "start long", held)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            fresh: defaultdict[int, Counter] = defaultdict(Counter)  # the batch's periods of this group
            for row in rows:
                fresh[row["_ms"] // period * period][row[column]] += 1
            for start, seen in sorted(fresh.items()):
                at = (start,)
                counts = dict(zip(*self.counts.getValue(at))) if self.counts.containsKey(at) else {}
                if not counts:
                    self.handle.registerTimer(start + period)
                crossed = [k for k, n in seen.items() if counts.get(k, 0) <= threshold < counts.get(k, 0) + n]
                for k, n in seen.items():
                    counts[k] = counts.get(k, 0) + n
                self.counts.updateValue(at, (list(counts), list(counts.values())))
                for k in crossed:
                    yield alert(k, start, "crossed", threshold + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            start = expiredTimerInfo.getExpiryTimeInMs() - period
            counts = self.counts.getValue((start,))
            self.counts.removeKey((start,))
            for k, n in zip(*counts):
                if n > threshold:
                    yield alert(k, start, "closed", n)

        def close(self) -> None:
            pass

    # The period is a matter of the time alone; rows without one belong to none.
    rows = with_click_watermark(stream.where(F.col(ts).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group"), key, ts, F.unix_millis(ts).alias("_ms")), delay, ts)
    alerts = rows.groupBy("_group").transformWithState(Periods(), out, "append", "EventTime")
    return alerts.select(key, F.timestamp_millis("_start").alias("window_start"),
                         F.timestamp_millis(F.col("_start") + period).alias("window_end"), "kind", "events")


def stream_cached_lookups(requests: DataFrame, code: str = "short_code", url: str = "table_url",
                          ttl: str = CACHE_TTL) -> DataFrame:
    """Where each request's answer comes from when table answers are kept for
    ``ttl`` (processing time, by state TTL): the first request of a code asks the
    table, the ones after it find the kept answer, as does each first one after
    the answer has expired.  A miss is not kept.

    ``requests`` carries the table's answer as ``url`` (null or empty: none).
    -> the columns of ``requests`` and ``source``.
    """
    import pandas as pd

    ttl_ms = pd.Timedelta(ttl) // pd.Timedelta(milliseconds=1)
    columns = requests.columns
    out = StructType([*requests.schema.fields, StructField("source", StringType())])
    answer = Row(*out.names)

    class Cache(StatefulProcessor):
        def init(self, handle) -> None:
            self.kept = handle.getValueState("kept", "url string", ttl_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            held = self.kept.get()[0] if self.kept.exists() else None
            found = None
            for row in rows:
                if held:
                    source = OUTCOME_CACHE_HIT
                elif row[url]:
                    held = found = row[url]
                    source = OUTCOME_TABLE_HIT
                else:
                    source = OUTCOME_TABLE_MISS
                yield answer(*[row[c] for c in columns], source)
            if found:
                self.kept.update((found,))

        def close(self) -> None:
            pass

    return requests.groupBy(code).transformWithState(Cache(), out, "append", "ProcessingTime")
