"""Parquet table loading.

Driver tables store naive microsecond timestamps, which Spark reads as
TIMESTAMP_NTZ.  Watermarks need TIMESTAMP, so every NTZ column is cast to
TIMESTAMP (the session time zone is UTC, so wall-clock values are kept).
The cast is a projection on top of the scan: column pruning and filter
pushdown still reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def with_utc_timestamps(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            cols.append(F.col(f.name).cast(T.TimestampType()).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return with_utc_timestamps(spark.read.parquet(path))


class Tables:
    """Lazy accessor: ``t("events")`` returns the (cast) events DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]

