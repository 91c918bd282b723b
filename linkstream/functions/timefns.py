"""Time helpers (Column -> Column); all JVM-side, codegen friendly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RFC3339 = "yyyy-MM-dd'T'HH:mm:ssXXX"
# Fraction of a second in front of the offset that ends the text.
_FRACTION = r"\.([0-9]{1,9})(?=(?:Z|[+-][0-9]{2}:[0-9]{2})$)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rfc3339_to_ts(col) -> Column:
    """RFC 3339 text (``Z`` or ``+hh:mm`` offset, up to 9 fraction digits) -> UTC
    timestamp, cut to microseconds; bad -> NULL."""
    c = _c(col)
    whole = F.try_to_timestamp(F.regexp_replace(c, _FRACTION, ""), F.lit(RFC3339))
    digits = F.rpad(F.substring(F.regexp_extract(c, _FRACTION, 1), 1, 6), 6, "0")
    return F.timestamp_micros(F.unix_micros(whole) + digits.cast("bigint"))


def to_rfc3339(col) -> Column:
    """Timestamp -> second-precision RFC 3339 text in UTC (``...Z``)."""
    return F.date_format(_c(col), RFC3339)


def start_of_hour(col) -> Column:
    return F.date_trunc("hour", _c(col))


def ts_literal(ts: str) -> Column:
    return F.to_timestamp(F.lit(ts))


def recent(df: DataFrame, ts: str, now: str, interval: str) -> DataFrame:
    """Rows with ``ts >= now - interval``; ``now`` is explicit for determinism."""
    return df.where(F.col(ts) >= ts_literal(now) - F.expr(f"INTERVAL {interval}"))


def since(df: DataFrame, ts: str, lower: str) -> DataFrame:
    return df.where(F.col(ts) >= ts_literal(lower))
