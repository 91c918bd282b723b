"""Redirect resolution: known-code guard, cache, table, labelled outcomes.

The original resolves one request at a time (guard -> cache -> table, with
single-flight collapsing concurrent lookups of a code).  As a batch job:
distinct codes first (each code is looked up once, a partial aggregate),
three left joins on the small distinct side, then one many-to-one join
back to the requests (``plans.joins.skew_safe_join``: AQE splits a hot code's
partition on the request side).  Join strategies are Spark's: a lookup side is
broadcast only when its measured size is under the broadcast threshold.

``resolve_redirects_as_of`` answers each request from the link table as it was
``staleness`` before that request's own time.  Creations, changes and requests
are one ordered log per code, and each request takes the last change before it
in a scan that cuts every code into ranges (``plans.scan``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstream.constants import (
    CACHE_MISS_ERROR, OUTCOME_CACHE_HIT, OUTCOME_EMPTY_CODE, OUTCOME_GUARD_MISS,
    OUTCOME_TABLE_HIT, OUTCOME_TABLE_MISS, READ_EDGE_BUCKET_PER_S, READ_LIMIT_PER_S,
    STALE_READ, WRITE_EDGE_BUCKET_PER_S, WRITE_LIMIT_PER_S,
)
from linkstream.functions.text import blank
from linkstream.plans.joins import BUCKET_COL, join_links, skew_safe_join
from linkstream.plans.scan import ordered, scan_last

# Limits configured in front of the original services (requests per second).
CONFIGURED_LIMITS = {"write": WRITE_LIMIT_PER_S, "read": READ_LIMIT_PER_S,
                     "write_edge": WRITE_EDGE_BUCKET_PER_S, "read_edge": READ_EDGE_BUCKET_PER_S}


def known_codes(created: DataFrame, resolved: DataFrame | None = None,
                created_col: str = "value", resolved_col: str = "short_code") -> DataFrame:
    """Set of codes ever created or resolved from the table; deletes never remove."""
    out = created.select(F.col(created_col).alias("short_code"))
    if resolved is not None:
        out = out.unionByName(resolved.select(F.col(resolved_col).alias("short_code")))
    return out.where(F.col("short_code").isNotNull()).distinct()


def guard_false_positives(known: DataFrame, links: DataFrame) -> DataFrame:
    """Known codes whose link is gone: they pass the guard and miss the table."""
    return known.join(links.select(F.col("id").alias("short_code")), "short_code", "left_anti")


def known_code_guard(requests: DataFrame, known: DataFrame,
                     code_col: str = "short_code") -> tuple[DataFrame, DataFrame]:
    """-> (requests whose code is known, rejected requests with the label)."""
    k = known.select(F.col("short_code").alias(code_col))
    passed = requests.join(k, code_col, "left_semi")
    rejected = requests.join(k, code_col, "left_anti").withColumn("outcome", F.lit(OUTCOME_GUARD_MISS))
    return passed, rejected


def resolve_redirects(requests: DataFrame, known: DataFrame, cache: DataFrame | None,
                      links: DataFrame, count_miss_as_error: bool = False,
                      link_buckets: int | None = None) -> DataFrame:
    """Outcome per request: status, source label, destination.  With
    ``link_buckets`` (a link table stored by ``sinks.write_links``) the table
    lookup also matches the bucket, so dynamic partition pruning can skip
    buckets no requested code falls in.  A cache entry with ``expires_at``
    holds for requests before it (by their ``ts``)."""
    codes = requests.select("short_code").where(~blank("short_code")).distinct()
    k = known.select("short_code", F.lit(True).alias("_known"))
    looked = codes.join(k, "short_code", "left")
    looked = looked.join(_cached(cache), "short_code", "left") if cache is not None else _uncached(looked)
    extra = [BUCKET_COL] if BUCKET_COL in links.columns else []
    t = links.select("id", F.col("long_url").alias("_table_url"), *extra)
    looked = join_links(looked, "short_code", t, "left", link_buckets).drop("id")
    # One lookup per code; whether its cache entry still holds is a matter of
    # each request's time.
    return _answered(skew_safe_join(requests, looked, "short_code"), count_miss_as_error)


def resolve_redirects_as_of(requests: DataFrame, created: DataFrame, cache: DataFrame | None, changes: DataFrame,
                            staleness: str = STALE_READ, count_miss_as_error: bool = False) -> DataFrame:
    """As ``resolve_redirects``, with the state of each request's own time.

    ``created`` (value, timestamp): a code is known from then on; ``changes``
    (id, op, long_url, commit_ts, seq): applied changes, of which a request sees
    those committed ``staleness`` before it or earlier ("0 seconds" is a strong
    read).  A code is therefore unknown, then missing in the table, then found;
    and still found for a while after its deletion.
    """
    columns = requests.columns
    asked = requests.where(~blank("short_code"))
    body = F.struct(*columns)
    log = (created.select(F.col("value").alias("_code"), F.col("timestamp").alias("_at"), F.lit(0).alias("_kind"))
                  .unionByName(changes.select(F.col("id").alias("_code"),
                                              (F.col("commit_ts") + F.expr(f"INTERVAL {staleness}")).alias("_at"), F.lit(1).alias("_kind"),
                                              F.col("seq").cast("bigint").alias("_seq"),
                                              F.struct("op", "long_url").alias("_change")), allowMissingColumns=True)
                  .unionByName(asked.select(F.col("short_code").alias("_code"), F.col("ts").alias("_at"), F.lit(2).alias("_kind"),
                                            body.alias("_request")), allowMissingColumns=True))
    log = ordered(log, ["_code"], ["_at", "_kind", "_seq"])
    log = scan_last(log, ["_code"], F.when(F.col("_kind") == 1, F.col("_change")), "_seen")
    log = scan_last(log, ["_code"], F.when(F.col("_kind") == 0, True), "_known")
    seen = log.where(F.col("_kind") == 2).select(
        "_request.*", "_known", F.when(F.col("_seen.op") != "delete", F.col("_seen.long_url")).alias("_table_url"))
    others = requests.where(blank("short_code")).select(
        *columns, F.lit(None).cast("boolean").alias("_known"), F.lit(None).cast("string").alias("_table_url"))
    out = seen.unionByName(others)
    out = skew_safe_join(out, _cached(cache), "short_code") if cache is not None else _uncached(out)
    return _answered(out, count_miss_as_error)


def _cached(cache: DataFrame) -> DataFrame:
    until = F.col("expires_at") if "expires_at" in cache.columns else F.lit(None)
    return cache.select("short_code", F.col("long_url").alias("_cache_url"), until.cast("timestamp").alias("_until"))


def _uncached(df: DataFrame) -> DataFrame:
    return df.withColumn("_cache_url", F.lit(None).cast("string")).withColumn("_until", F.lit(None).cast("timestamp"))


def _answered(out: DataFrame, count_miss_as_error: bool) -> DataFrame:
    """Requests with what was looked up for them -> outcome, status, destination."""
    cached = F.col("_cache_url").isNotNull() & (F.col("_until").isNull() | (F.col("ts") < F.col("_until")))
    source = (F.when(~F.coalesce(F.col("_known"), F.lit(False)), F.lit(OUTCOME_GUARD_MISS))
               .when(cached, F.lit(OUTCOME_CACHE_HIT))
               .when(F.col("_table_url").isNotNull() & (F.col("_table_url") != ""), F.lit(OUTCOME_TABLE_HIT))
               .otherwise(F.lit(OUTCOME_TABLE_MISS)))
    out = out.withColumn("source", source).withColumn(
        "long_url", F.when(F.col("source") == OUTCOME_CACHE_HIT, F.col("_cache_url"))
                     .when(F.col("source") == OUTCOME_TABLE_HIT, F.col("_table_url")))
    out = out.drop("_known", "_cache_url", "_until", "_table_url")
    src = F.when(blank("short_code"), F.lit(OUTCOME_EMPTY_CODE)).otherwise(F.col("source"))
    status = (F.when(src == OUTCOME_EMPTY_CODE, F.lit(400))
               .when(src.isin(OUTCOME_CACHE_HIT, OUTCOME_TABLE_HIT), F.lit(302))
               .otherwise(F.lit(404)))
    out = out.withColumn("source", src).withColumn("status", status)
    if count_miss_as_error:
        # The cache client reports a miss as an error, so every request that
        # reached the cache and missed also counts one cache error.
        out = out.withColumn("cache_error", F.when(src.isin(OUTCOME_TABLE_HIT, OUTCOME_TABLE_MISS),
                                                   F.lit(CACHE_MISS_ERROR)))
    return out


def clicks_from_redirects(resolved: DataFrame, country: str = "Unknown") -> DataFrame:
    """Successful redirects (302) become click events."""
    return (resolved.where(F.col("status") == 302)
                    .select(F.col("ts").alias("event_time"), "short_code", F.lit(country).alias("country_code")))


def cache_hit_ratio(resolved: DataFrame, bucket: str = "hour") -> DataFrame:
    """hits / (hits + misses) of the requests that reached the cache, per bucket."""
    hit = (F.col("source") == OUTCOME_CACHE_HIT).cast("bigint")
    miss = F.col("source").isin(OUTCOME_TABLE_HIT, OUTCOME_TABLE_MISS).cast("bigint")
    agg = (resolved.groupBy(F.date_trunc(bucket, "ts").alias("bucket"))
                   .agg(F.sum(hit).alias("hits"), F.sum(miss).alias("misses")))
    return agg.withColumn("hit_ratio", F.round(F.try_divide(F.col("hits").cast("double"),
                                                            (F.col("hits") + F.col("misses")).cast("double")), 9))


def rate_limit_audit(requests: DataFrame, descriptor: list[str], limit: int,
                     unit: str = "1 second", ts: str = "ts") -> DataFrame:
    """Requests over ``limit`` per descriptor and tumbling window of ``unit``.

    The limiter itself is not rebuilt; this reports where it would have
    fired and by how much.
    """
    w = F.window(ts, unit)
    agg = requests.groupBy(*descriptor, w.alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return (agg.where(F.col("requests") > limit)
               .select(*descriptor, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                       "requests", (F.col("requests") - F.lit(limit)).alias("excess")))


def audit_configured_limit(requests: DataFrame, kind: str, descriptor: list[str] | None = None,
                           ts: str = "ts") -> DataFrame:
    """``rate_limit_audit`` with one of the configured per-second limits."""
    return rate_limit_audit(requests, list(descriptor or []), CONFIGURED_LIMITS[kind], "1 second", ts)
