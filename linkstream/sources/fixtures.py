"""Stand-in views of the link-traffic tables, derived from the driver tables.

Every view reads a whole driver table and grows with it.  The integer
rules below derive *attributes* (a NULL country header, a bot user agent,
a malformed JSON body, a deleted link, an anonymous owner) from row ids;
none of them samples or caps the data for cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstream.constants import OUTCOME_GUARD_MISS, OUTCOME_TABLE_MISS
from linkstream.functions.text import default_country
from linkstream.sources.tables import Tables

BASE_TS = "2024-01-01 00:00:00"
NOW = "2024-01-30 23:59:59"  # fixed "now" of the last-hour / last-day queries


def code_of(col) -> Column:
    """Integer id -> 11-character zero-padded code."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lpad(c.cast("string"), 11, "0")


def clicks(t: Tables) -> DataFrame:
    e = t("events")
    raw_country = F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("string")) \
                   .otherwise(F.concat(F.lit("C"), F.lpad((F.col("event_id") % 25).cast("string"), 2, "0")))
    return (e.where(F.col("event_type") == "click")
             .select("event_id",
                     F.col("ts").alias("event_time"),
                     code_of("user_id").alias("short_code"),
                     default_country(raw_country).alias("country_code"),
                     F.when(F.col("event_id") % 20 == 0, F.lit("bot/1.0"))
                      .otherwise(F.lit("Mozilla/5.0")).alias("user_agent")))


def click_json(t: Tables) -> DataFrame:
    c = clicks(t)
    offset = F.when(F.col("event_id") % 3 == 0, F.lit("+05:30")).otherwise(F.lit("Z"))
    stamp = F.date_format(F.date_trunc("second", "event_time"), "yyyy-MM-dd'T'HH:mm:ss")
    body = F.concat(F.lit('{"short_code":"'), F.col("short_code"),
                    F.lit('","timestamp":"'), stamp, offset,
                    F.lit('","country":"'), F.col("country_code"),
                    F.lit('","user_agent":"'), F.col("user_agent"), F.lit('"}'))
    return c.select("event_id",
                    F.when(F.col("event_id") % 50 == 0, F.lit("{oops")).otherwise(body).alias("value"))


def url_mappings(t: Tables) -> DataFrame:
    p = t("pages")
    return (p.where(F.col("page_id") % 7 != 3)
             .select(code_of("page_id").alias("id"),
                     F.col("url").alias("long_url"),
                     F.when(F.col("page_id") % 4 == 0, F.lit(None).cast("string"))
                      .otherwise(F.concat(F.lit("user"), (F.col("page_id") % 20).cast("string"))).alias("user_id"),
                     (F.to_timestamp(F.lit(BASE_TS)) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("page_id").cast("int")))
                     .alias("created_at")))


def link_mutations(t: Tables) -> DataFrame:
    o = t("orders")
    mismatch = F.when(F.col("o_orderkey") % 9 == 0, F.lit(1)).otherwise(F.lit(0))
    return o.select(
        code_of("o_custkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", F.lit("insert"))
         .when(F.col("o_orderstatus") == "F", F.lit("update"))
         .otherwise(F.lit("delete")).alias("op"),
        F.concat(F.lit("https://example.com/"), F.col("o_orderkey").cast("string")).alias("long_url"),
        F.concat(F.lit("user"), ((F.col("o_custkey") + mismatch) % 20).cast("string")).alias("user_id"),
        F.col("o_orderdate").alias("commit_ts"),
        F.col("o_orderkey").alias("seq"))


def link_changes(t: Tables) -> DataFrame:
    """A change log of links over the month of the events: applied changes with commit times."""
    o = t("orders")
    return o.select(
        code_of("o_custkey").alias("id"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("delete")).when(F.col("o_orderkey") % 5 == 1, F.lit("update"))
         .otherwise(F.lit("insert")).alias("op"),
        F.concat(F.lit("https://example.com/"), F.col("o_orderkey").cast("string")).alias("long_url"),
        F.concat(F.lit("user"), (F.col("o_custkey") % 20).cast("string")).alias("user_id"),
        (F.to_timestamp(F.lit(BASE_TS)) + F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), ((F.col("o_orderkey") * 7919) % 2592000).cast("decimal(18,6)"))).alias("commit_ts"),
        F.col("o_orderkey").alias("seq"))


def redirect_requests(t: Tables) -> DataFrame:
    e = t("events")
    return e.select(F.col("event_id").alias("request_id"), "ts",
                    F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("zz"), F.col("event_id").cast("string")))
                     .otherwise(code_of("user_id")).alias("short_code"))


def cache_entries(t: Tables) -> DataFrame:
    """Cache contents: every third live link (a warm subset of the table); an
    entry expires 1 to 28 days into the month."""
    m = url_mappings(t)
    return m.where(F.substring("id", 11, 1).isin("0", "3", "6", "9")).select(
        F.col("id").alias("short_code"), "long_url",
        (F.to_timestamp(F.lit(BASE_TS)) + F.make_dt_interval((F.col("id").cast("bigint") % 28 + 1).cast("int"))).alias("expires_at"))


def metric_points(t: Tables) -> DataFrame:
    e = t("events")
    return e.select("ts", F.col("event_type").alias("service"),
                    F.lit("http_requests_total").alias("name"),
                    F.when(F.col("event_id") % 2 == 0, F.lit("GET")).otherwise(F.lit("POST")).alias("method"),
                    F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(302)).alias("status_code"),
                    (F.col("value") / 1000).alias("duration"),
                    F.when(F.col("event_id") % 3 == 0, F.lit("/shorten")).otherwise(F.lit("/:code")).alias("path"),
                    F.when(F.col("event_type") != "error", F.lit(None).cast("string"))
                     .when(F.col("event_id") % 2 == 0, F.lit(OUTCOME_GUARD_MISS))
                     .otherwise(F.lit(OUTCOME_TABLE_MISS)).alias("reason"),
                    (F.col("event_id") % 4 + 1).cast("bigint").alias("amount"))


def app_logs(t: Tables) -> DataFrame:
    e = t("events")
    attr_k = F.regexp_extract("props", "[0-9]+", 0)
    return e.select(F.col("ts").alias("timestamp"),
                    F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("service_name"),
                    F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("level"),
                    F.create_map(F.lit("k"), attr_k).alias("attributes"),
                    (F.col("event_id") % 150).alias("trace_id"))


def sensor_data(t: Tables) -> DataFrame:
    e = t("events")
    return e.select(F.col("ts").alias("timestamp"), F.col("user_id").alias("sensor_id"),
                    F.col("value").alias("temperature"))


def stock_trades(t: Tables) -> DataFrame:
    li = t("lineitem")
    return li.select(F.col("l_shipdate").alias("timestamp"),
                     F.concat(F.lit("S"), (F.col("l_partkey") % 50).cast("string")).alias("symbol"),
                     (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                     F.col("l_quantity").alias("volume"))


def user_events(t: Tables) -> DataFrame:
    e = t("events")
    return (e.where(F.col("event_type").isin("view", "click", "purchase"))
             .select(F.col("ts").alias("timestamp"), "user_id", "event_type",
                     F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("product_id"),
                     F.col("value").alias("amount")))


def spans(t: Tables) -> DataFrame:
    c = t("conversations")
    return c.select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"),
        F.when(F.col("turn") == 0, F.lit(None).cast("bigint")).otherwise(F.col("turn") - 1).alias("parent_span_id"),
        F.col("role").alias("service"),
        (F.to_timestamp(F.lit(BASE_TS))
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("decimal(18,6)")))
        .alias("start_ts"),
        F.length("text").cast("bigint").alias("duration_ms"),
        F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, F.lit("ERROR")).otherwise(F.lit("OK")).alias("status"))


def shorten_requests(t: Tables) -> DataFrame:
    """Shorten-API bodies derived from pages: valid, empty-URL, bad JSON,
    custom slugs, anonymous callers."""
    p = t("pages")
    pid = F.col("page_id")
    url = F.when(pid % 13 == 0, F.lit("")).otherwise(F.col("url"))
    slug = F.when(pid % 5 == 0, F.concat(F.lit("s"), pid.cast("string"))).otherwise(F.lit(""))
    body = F.to_json(F.struct(url.alias("long_url"), slug.alias("custom_slug")))
    return p.select(pid.alias("request_id"),
                    F.when(pid % 11 == 0, F.lit("invalid json")).otherwise(body).alias("body"),
                    F.when(pid % 4 == 0, F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("user"), (pid % 20).cast("string"))).alias("user_id"))


def created_events(t: Tables) -> DataFrame:
    """Created-code stream rows (key = value = code) with their time: one per
    link ever created, including links deleted later."""
    p = t("pages")
    code = code_of("page_id")
    return p.select(code.alias("key"), code.alias("value"),
                    (F.to_timestamp(F.lit(BASE_TS)) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("page_id").cast("int")))
                    .alias("timestamp"))
