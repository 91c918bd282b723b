"""Stored tables by day, and their retention: whole days go with their folder,
the day of the cutoff is written again, and no other day is read or touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstream.functions.timefns import ts_literal
from linkstream.sources import files


def write_by_day(df: DataFrame, path: str, ts: str, files_per_day: int = 16, mode: str = "append") -> None:
    """Append ``df`` to the table at ``path``, a folder a day."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_day))
    (df.withColumn("day", F.to_date(ts)).repartition(F.col("day"), spread)
       .write.mode(mode).partitionBy("day").parquet(path))


def day_rows(spark: SparkSession, path: str, day: str) -> DataFrame:
    """The rows of one day; other folders are not even listed."""
    return spark.read.option("basePath", path).parquet(f"{path}/day={day}")


def drop_expired(spark: SparkSession, path: str, ts: str, now: str, keep: str) -> list[str]:
    """Remove rows older than ``keep`` before ``now``; -> the days that went or changed.

    The day of the cutoff is replaced by dynamic partition overwrite, which puts
    the new files in place after all are written.  A second run changes nothing.
    Rows whose time is null lie in no day, and stay.
    """
    cutoff = ts_literal(now) - F.expr(f"INTERVAL {keep}")
    edge = spark.range(1).select(F.to_date(cutoff).cast("string").alias("day"), (cutoff == F.date_trunc("day", cutoff)).alias("whole")).first()
    days = [n.split("=", 1)[1] for n in files.names(spark, path) if n.startswith("day=") and n[4:5].isdigit()]
    gone = [d for d in days if d < edge["day"]]
    for day in gone:
        files.remove(spark, f"{path}/day={day}")
    if edge["whole"] or edge["day"] not in days:
        return gone
    rows = day_rows(spark, path, edge["day"])
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(ts) >= cutoff, 1)).alias("kept")).first()
    if not counts["kept"]:
        files.remove(spark, f"{path}/day={edge['day']}")
    elif counts["kept"] < counts["n"]:
        (rows.where(F.col(ts) >= cutoff).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("day").parquet(path))
    else:
        return gone
    return [*gone, edge["day"]]
