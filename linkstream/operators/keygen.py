"""Bulk short-code assignment and the shorten-request path.

The original service hands out ids from contiguous blocks of 1,000,000
(coordinated through a key-value store) or from a time/node/sequence
layout, then obfuscates and base-62 encodes them, one request at a time.
As a batch job the same ids come from a distributed numbering:

* ``segment`` mode: id = start + global position of the row in a total
  order (range-partitioned sort + per-partition offsets; no
  single-partition window), block = (id - start) // block_size;
* ``snowflake`` mode: (batch time ms, partition as node, index as
  sequence), carrying into the next millisecond every 4096 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkstream.constants import ID_BLOCK_SIZE, REASON_BAD_BODY, REASON_MISSING_URL, SNOWFLAKE_NODE_BITS, SNOWFLAKE_SEQ_BITS
from linkstream.functions.codes import short_code_for_id, snowflake_compose, snowflake_decode
from linkstream.functions.text import blank, build_short_url, strip_scheme
from linkstream.plans.ranking import global_row_number, stable
from linkstream.schemas import SHORTEN_REQUEST


def validate_requests(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Parse JSON bodies; ``reason`` is NULL for accepted requests and
    ``status`` is the response code the shorten API gives (201 created,
    400 for a bad body or a missing URL)."""
    j = F.from_json(F.col(body_col), SHORTEN_REQUEST,
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    p = df.withColumn("_j", j)
    reason = (F.when(F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull(), F.lit(REASON_BAD_BODY))
               .when(blank(F.col("_j.long_url")), F.lit(REASON_MISSING_URL)))
    keep = [c for c in df.columns if c != body_col]
    return p.select(*keep, F.col("_j.long_url").alias("long_url"),
                    F.col("_j.custom_slug").alias("custom_slug"), reason.alias("reason"),
                    F.when(reason.isNull(), F.lit(201)).otherwise(F.lit(400)).alias("status"))


def choose_slug(df: DataFrame, user_col: str = "user_id", slug_col: str = "custom_slug") -> DataFrame:
    """A custom slug is used only when both the user id and the slug are non-empty."""
    use = ~blank(user_col) & ~blank(slug_col)
    return df.withColumn("use_custom", use)


def assign_short_codes(df: DataFrame, order_col: str, start_id: int = 0, mode: str = "segment",
                       block: int = ID_BLOCK_SIZE, obfuscate: bool = True,
                       batch_ms: int | None = None, last_ms: int | None = None) -> DataFrame:
    """Give every row needing a generated code a unique id and its code.

    Rows with ``use_custom`` (if present) keep their slug and take no id.
    A snowflake batch of many rows runs into later milliseconds; give the next
    batch the ``last_millisecond`` of this one as ``last_ms``, and it starts
    after it, so no id comes twice.
    """
    has_custom = "use_custom" in df.columns
    need = df.where(~F.col("use_custom")) if has_custom else df
    if mode == "segment":
        numbered = global_row_number(need, [F.col(order_col).asc()], out="id", start=start_id)
        numbered = numbered.withColumn("block_id", F.floor((F.col("id") - F.lit(start_id)) / F.lit(block)).cast("bigint"))
        coded = numbered.withColumn("short_code", short_code_for_id("id", obfuscate))
    elif mode == "snowflake":
        if batch_ms is None:
            raise ValueError("snowflake mode needs batch_ms")
        if last_ms is not None:
            batch_ms = max(batch_ms, last_ms + 1)
        # One node id per partition; partitions beyond the nodes share one, each
        # going on where those before it end (a row a partition, so broadcast).
        base = stable(need.withColumn("_mid", F.monotonically_increasing_id()))
        base = base.withColumn("_pid", F.shiftright("_mid", 33))
        node = F.col("_pid") % (1 << SNOWFLAKE_NODE_BITS)
        sizes = base.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(node).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
        base = base.join(F.broadcast(starts), "_pid")
        idx = F.col("_from") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
        per_ms = 1 << SNOWFLAKE_SEQ_BITS
        ident = snowflake_compose(F.lit(batch_ms) + F.floor(idx / per_ms).cast("bigint"), node, idx % per_ms)
        coded = (base.withColumn("id", ident).withColumn("block_id", F.lit(None).cast("bigint"))
                     .withColumn("short_code", short_code_for_id("id", obfuscate=False)).drop("_mid", "_pid", "_from"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if has_custom:
        custom = (df.where(F.col("use_custom"))
                    .withColumn("id", F.lit(None).cast("bigint"))
                    .withColumn("block_id", F.lit(None).cast("bigint"))
                    .withColumn("short_code", F.col("custom_slug")))
        coded = coded.unionByName(custom)
    return coded


def last_millisecond(coded: DataFrame) -> int | None:
    """The last millisecond that a snowflake batch used; None if it has no id."""
    return coded.agg(F.max(F.unix_millis(snowflake_decode("id")["ts"]))).first()[0]


def code_collisions(new: DataFrame, links: DataFrame, code_col: str = "short_code") -> DataFrame:
    """Codes used more than once in the batch, or already taken in the link table."""
    in_batch = (new.groupBy(code_col).agg(F.count(F.lit(1)).alias("n"))
                   .where(F.col("n") > 1).select(code_col, F.lit("duplicate_in_batch").alias("kind")))
    taken = (new.select(code_col).distinct()
                .join(links.select(F.col("id").alias(code_col)), code_col, "left_semi")
                .select(code_col, F.lit("exists_in_table").alias("kind")))
    return in_batch.unionByName(taken)


def with_short_url(df: DataFrame, base: str, code_col: str = "short_code") -> DataFrame:
    """``short_url``, and ``short_url_display`` without its scheme."""
    out = df.withColumn("short_url", build_short_url(F.lit(base), F.col(code_col)))
    return out.withColumn("short_url_display", strip_scheme("short_url"))
