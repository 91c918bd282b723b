"""Canonical schemas (StructType) of the link-traffic data model."""

from pyspark.sql import types as T

# Click event as produced by the redirect path: four string fields.
CLICK_JSON = T.StructType([
    T.StructField("short_code", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

CLICK = T.StructType([
    T.StructField("event_time", T.TimestampType()),
    T.StructField("short_code", T.StringType()),
    T.StructField("country_code", T.StringType()),
    T.StructField("user_agent", T.StringType()),
])

# A batch's partial of the hourly roll-up; ``visitors`` is a sketch of distinct visitors, or null.
HOURLY_PARTIAL = T.StructType([
    T.StructField("hour", T.TimestampType()),
    T.StructField("short_code", T.StringType()),
    T.StructField("country_code", T.StringType()),
    T.StructField("total_clicks", T.LongType()),
    T.StructField("visitors", T.BinaryType()),
])

URL_MAPPING = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("long_url", T.StringType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("created_at", T.TimestampType(), False),
])

# A code and its clicks so far, as the dashboard feed keeps them.
TOP_TOTAL = T.StructType([
    T.StructField("short_code", T.StringType()),
    T.StructField("total_clicks", T.LongType()),
])

SHORTEN_REQUEST = T.StructType([
    T.StructField("long_url", T.StringType()),
    T.StructField("custom_slug", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

# Telemetry export, by kind.
SPAN = T.StructType([
    T.StructField("trace_id", T.LongType()),
    T.StructField("span_id", T.LongType()),
    T.StructField("parent_span_id", T.LongType()),
    T.StructField("service", T.StringType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("status", T.StringType()),
])

METRIC_POINT = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("service", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("path", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("amount", T.LongType()),
])

LOG_RECORD = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("service_name", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("trace_id", T.LongType()),
])

TELEMETRY = {"spans": SPAN, "metrics": METRIC_POINT, "logs": LOG_RECORD}
