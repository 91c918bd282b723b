"""Click roll-ups: hourly partial counts and their merges.

The hourly table holds *partial* counts: the same (hour, code, country)
key may appear in several rows (one per ingested batch) and every reader
sums them.  All aggregations here are plain ``groupBy().agg()``, so Spark
runs a map-side partial aggregate before the shuffle; a hot short code
is reduced to one row per task before it crosses the network.

A partial may also hold a sketch of its visitors: a mergeable state of a few
kilobytes at most, from which readers estimate distinct visitors of any longer
period or any set of codes (within about 1.6 %; small numbers are exact).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstream.functions.timefns import recent, start_of_hour
from linkstream.sources.fixtures import NOW

ROLLUP_KEY = ("hour", "short_code", "country_code")


def hourly_rollup(clicks: DataFrame, ts: str = "event_time", visitor: str | Column | None = None) -> DataFrame:
    """Count per (start of hour, short_code, country_code); with ``visitor`` also
    a sketch of its distinct values (``visitors``)."""
    sketch = [F.hll_sketch_agg(visitor).alias("visitors")] if visitor is not None else []
    return (clicks.groupBy(start_of_hour(ts).alias("hour"), "short_code", "country_code")
                  .agg(F.count(F.lit(1)).alias("total_clicks"), *sketch))


def merged_visitors() -> Column:
    """The union of the rows' sketches; null where no row has one."""
    return F.when(F.count("visitors") > 0, F.hll_union_agg("visitors"))


def compact_rollup(partials: DataFrame) -> DataFrame:
    """Collapse rows with an equal key into one (merge of partial counts and sketches)."""
    sketch = [merged_visitors().alias("visitors")] if "visitors" in partials.columns else []
    return (partials.groupBy(*ROLLUP_KEY)
                    .agg(F.sum("total_clicks").cast("bigint").alias("total_clicks"), *sketch))


def unique_visitors(rollup: DataFrame, period: str = "day", by: Sequence[str] = ("short_code",)) -> DataFrame:
    """Distinct visitors per period and ``by``, from the partials' sketches."""
    return (rollup.groupBy(F.date_trunc(period, "hour").alias("period"), *by)
                  .agg(F.coalesce(F.hll_sketch_estimate(merged_visitors()), F.lit(0)).alias("visitors")))


def clicks_by_code(rollup: DataFrame) -> DataFrame:
    """Merge partial counts into one total per code."""
    return (rollup.groupBy("short_code")
                  .agg(F.sum("total_clicks").cast("bigint").alias("total_clicks")))


def clicks_by_country(rollup: DataFrame, by_hour: bool = False) -> DataFrame:
    keys = ["hour", "country_code"] if by_hour else ["country_code"]
    return rollup.groupBy(*keys).agg(F.sum("total_clicks").cast("bigint").alias("total_clicks"))


def totals_last_24h(rollup: DataFrame, key: str = "short_code", now: str = NOW) -> DataFrame:
    """Per-key total of rollup rows whose hour is within 24 h of ``now``."""
    return (recent(rollup, "hour", now, "24 HOURS")
            .groupBy(key).agg(F.sum("total_clicks").cast("bigint").alias("total_clicks")))


def created_per_hour(created: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Created-code events per hour."""
    return created.groupBy(start_of_hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("created"))
