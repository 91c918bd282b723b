"""Stream sources: the click topic and the created-code topic.

``cfg["format"] == "kafka"`` reads the broker (start at the earliest
offset, consumer group id, offsets per trigger as configured); any other format
(``json``, ``text``, ``parquet``) reads files of the same messages, which is
how the tests drive the same code (no broker in the container).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def _kafka(spark: SparkSession, cfg: dict, topic: str) -> DataFrame:
    r = (spark.readStream.format("kafka")
         .option("kafka.bootstrap.servers", cfg["bootstrap"])
         .option("subscribe", cfg.get("topic", topic))
         .option("startingOffsets", cfg.get("starting_offsets", "earliest")))
    if cfg.get("max_offsets_per_trigger"):
        r = r.option("maxOffsetsPerTrigger", str(cfg["max_offsets_per_trigger"]))
    if cfg.get("group_id"):
        r = r.option("kafka.group.id", cfg["group_id"])
    return r.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                           "partition", "offset", F.col("timestamp").alias("ingest_ts"))


def _files(spark: SparkSession, cfg: dict) -> DataFrame:
    r = spark.readStream.format(cfg.get("format", "json")).schema(cfg.get("schema", MESSAGE))
    if cfg.get("max_files_per_trigger"):
        r = r.option("maxFilesPerTrigger", str(cfg["max_files_per_trigger"]))
    return r.load(cfg["path"])


def read_clicks_stream(spark: SparkSession, cfg: dict) -> DataFrame:
    """Click messages (JSON text in ``value``)."""
    if cfg.get("format") == "kafka":
        return _kafka(spark, cfg, "click-events")
    return _files(spark, cfg)


def read_created_stream(spark: SparkSession, cfg: dict) -> DataFrame:
    """Created-code messages: key = value = short code."""
    if cfg.get("format") == "kafka":
        return _kafka(spark, cfg, "url-created")
    return _files(spark, cfg)
