"""Click events: parsing, projection, routing, de-duplication, publishing.

All row-level work is Column expressions (``from_json``, ``try_to_timestamp``,
``to_json``); nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstream.constants import CODE_PATTERN
from linkstream.functions.text import blank, default_country, valid_code
from linkstream.functions.timefns import rfc3339_to_ts, to_rfc3339
from linkstream.schemas import CLICK_JSON

BOT_PATTERN = "(?i)(bot|crawler|spider)"
CLICK_COLS = ["event_time", "short_code", "country_code", "user_agent"]


def _parsed(df: DataFrame, value_col: str) -> DataFrame:
    j = F.from_json(F.col(value_col), CLICK_JSON,
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = df.withColumn("_j", j)
    event_time = rfc3339_to_ts(F.col("_j.timestamp"))
    reason = (F.when(F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull(), F.lit("malformed_json"))
               .when(blank(F.col("_j.short_code")), F.lit("missing_short_code"))
               .when(blank(F.col("_j.timestamp")), F.lit("missing_timestamp"))
               .when(event_time.isNull(), F.lit("bad_timestamp")))
    keep = [c for c in df.columns if c != value_col]
    return parsed.select(*keep, F.col(value_col),
                         event_time.alias("event_time"),
                         F.col("_j.short_code").alias("short_code"),
                         default_country(F.col("_j.country")).alias("country_code"),
                         F.col("_j.user_agent").alias("user_agent"),
                         reason.alias("reject_reason"))


def parse_clicks(df: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON click messages -> (typed clicks, rejects with a reason).

    Malformed JSON, a missing code or timestamp, or an unparsable timestamp
    go to the reject output instead of failing the job.
    """
    p = _parsed(df, value_col)
    keep = [c for c in df.columns if c != value_col]
    good = p.where(F.col("reject_reason").isNull()).select(*keep, *CLICK_COLS)
    bad = p.where(F.col("reject_reason").isNotNull()).select(*keep, F.col(value_col), "reject_reason")
    return good, bad


def project_click(df: DataFrame) -> DataFrame:
    """Rename the producer's ``country`` to ``country_code``; keep the sink columns."""
    country = "country" if "country" in df.columns else "country_code"
    return df.select("event_time", "short_code", F.col(country).alias("country_code"))


def is_bot(user_agent: Column, pattern: str = BOT_PATTERN) -> Column:
    return F.coalesce(user_agent.rlike(pattern), F.lit(False))


def route_clicks(df: DataFrame, value_col: str = "value", bot_pattern: str = BOT_PATTERN) -> DataFrame:
    """One pass, one tag column: ``reject`` | ``bot`` | ``main``."""
    p = _parsed(df, value_col)
    route = (F.when(F.col("reject_reason").isNotNull(), F.lit("reject"))
              .when(is_bot(F.col("user_agent"), bot_pattern), F.lit("bot"))
              .otherwise(F.lit("main")))
    return p.withColumn("route", route)


def split_clicks(df: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """-> (main, bots, rejects): the side-output pattern as filters on one tag.

    In a stream the tagged micro-batch is persisted once and written to the
    three sinks (see ``linkstream.streaming.ingest``).
    """
    tagged = route_clicks(df, value_col)
    keep = [c for c in df.columns if c != value_col]
    main = tagged.where(F.col("route") == "main").select(*keep, *CLICK_COLS)
    bots = tagged.where(F.col("route") == "bot").select(*keep, *CLICK_COLS)
    rejects = tagged.where(F.col("route") == "reject").select(*keep, F.col(value_col), "reject_reason")
    return main, bots, rejects


def dedup_clicks(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Drop redelivered events.  Clicks carry no id of their own, so the key
    is a supplied event id (or the source position); partial aggregation
    runs before the shuffle."""
    return df.dropDuplicates(keys or ["event_id"])


def dedup_created(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["key", "value"])


def valid_code_filter(df: DataFrame, pattern: str = CODE_PATTERN, col: str = "short_code") -> DataFrame:
    return df.where(valid_code(col, pattern))


def publish_clicks(clicks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Click rows -> one JSON message each (no key), the producer's layout."""
    value = F.to_json(F.struct(F.col("short_code").alias("short_code"),
                               to_rfc3339("event_time").alias("timestamp"),
                               F.col("country_code").alias("country"),
                               F.col("user_agent").alias("user_agent")))
    return clicks.select(*keep, F.lit(None).cast("string").alias("key"), value.alias("value"))


def publish_created(codes: DataFrame, code_col: str = "id") -> DataFrame:
    """Created events: key = value = short code."""
    return codes.select(F.col(code_col).alias("key"), F.col(code_col).alias("value"))
