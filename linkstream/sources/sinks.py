"""Sinks.  Every micro-batch writer is idempotent on replay: output goes to
a directory named by the batch id and is overwritten, so a batch that is
re-run after a failure replaces its own earlier attempt instead of adding
duplicates (the original's batched JDBC sink could duplicate rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from linkstream.constants import SINK_BATCH_ROWS
from linkstream.operators.rollup import hourly_rollup
from linkstream.schemas import URL_MAPPING
from linkstream.plans.joins import BUCKET_COL, LINK_BUCKETS, key_bucket


def batch_dir(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def write_rollup(path: str, ts: str = "event_time", visitor: str | Column | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: raw click rows are not stored, only the batch's
    partial counts (and visitor sketches) per (hour, code, country) under ``batch_id=N``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (hourly_rollup(batch, ts, visitor).write.mode("overwrite").parquet(batch_dir(path, batch_id)))
    return write


def write_clicks_jdbc(cfg: dict) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of (event_time, short_code, country_code).

    With ``cfg["url"]`` it writes through JDBC in batches of 1000 rows; the
    default target is Parquet per batch id (idempotent).  JDBC writes are
    append-only and so at least once: a replayed batch or task adds its rows
    again, and readers can tell a batch by the ``batch_id`` column only.  The original's 5 write retries are Spark's task
    retries here (``spark.task.maxFailures``, default 4 attempts; set it to
    ``SINK_MAX_RETRIES`` + 1 to match).
    """
    cols = ["event_time", "short_code", "country_code"]

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*cols)
        if cfg.get("url"):
            (rows.withColumn("batch_id", F.lit(batch_id)).write.format("jdbc")
                 .option("url", cfg["url"]).option("dbtable", cfg.get("table", "click_events"))
                 .option("batchsize", str(cfg.get("batchsize", SINK_BATCH_ROWS)))
                 .options(**cfg.get("options", {})).mode("append").save())
        else:
            rows.write.mode("overwrite").parquet(batch_dir(cfg["path"], batch_id))
    return write


def write_split(paths: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of a tagged batch (``route`` column) to one
    directory per route; the batch is persisted once and read per route."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for route, path in paths.items():
                (batch.where(F.col("route") == route).drop("route")
                      .write.mode("overwrite").parquet(batch_dir(path, batch_id)))
        finally:
            batch.unpersist()
    return write


def write_created_feed(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("key", "value").write.mode("overwrite").parquet(batch_dir(path, batch_id))
    return write


def write_known_codes(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("short_code").write.mode("overwrite").parquet(batch_dir(path, batch_id))
    return write


def write_links(links: DataFrame, path: str, buckets: int = LINK_BUCKETS, mode: str = "overwrite") -> None:
    """Store a link table partitioned by ``id_bucket`` (see plans.joins)."""
    # Rows of a bucket meet first, or each task would write a file per bucket.
    (links.withColumn(BUCKET_COL, key_bucket("id", buckets)).repartition(BUCKET_COL)
          .write.mode(mode).partitionBy(BUCKET_COL).parquet(path))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """The link table that ``write_links`` stored, with its bucket column."""
    return spark.read.schema(StructType([*URL_MAPPING.fields]).add(BUCKET_COL, LongType())).parquet(path)
