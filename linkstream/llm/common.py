"""Helpers shared by the corpus operators.

Nothing here holds per-document state on the driver; the only actions are
reliable checkpoints (``spark.checkpoint.dir``) and counts of small tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkstream.session import checkpoint_dir
from linkstream.sources.tables import read_table

#: Equal (group, bucket) cells of ``dense_slots`` are numbered in one task each.
SLOT_BUCKETS = 1024
#: Largest number of copies of one row that a task expands at once.
COPY_CHUNK = 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table of the shared folder, in folders by the columns ``by``.
    For loops: a checkpoint keeps the size estimate of the plan before it, which
    joins multiply in every round.  And for the small side of a join with a hot
    key: Spark splits it only between two plain exchanges, not behind an aggregate."""
    path = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # an empty table has no files by folder


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def unit_hash(*parts: Column) -> Column:
    """A uniform draw in (0, 1) from the md5 of the parts: 52 bits, so every
    value is an exact double and any SQL engine with md5 gets the same one."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(float(1 << 52))


def dense_slots(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str,
                buckets: int = SLOT_BUCKETS) -> DataFrame:
    """``out`` = gapless number from 0 of each row inside its group, without
    one task per group.

    Equal rows are counted first (map-side), so a row repeated many times is
    one row here and its numbers are a range.  Distinct rows are dealt into
    ``buckets`` hash buckets per group; a bucket starts where the buckets
    before it end (a window over one small row per bucket), and a running
    sum inside the bucket does the rest.  Only ``group`` and ``order``
    columns are kept; ``order`` should identify a row as far as it can.
    Numbers follow (bucket, order), and are the same on every run.
    """
    group, order = list(group), list(order)
    keys = [*group, *order]
    counted = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
                 .withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")))
    sizes = counted.groupBy(*group, "_bucket").agg(F.sum("_copies").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_b"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = (Window.partitionBy(*group, "_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("_at", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    cond = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_bucket") == F.col("_b")]
    placed = placed.join(starts, cond).select(
        *keys, (F.col("_start") + F.col("_at")).alias("_first"), "_copies")
    return expand_copies(placed, "_copies", "_copy").select(
        *keys, (F.col("_first") + F.col("_copy")).cast("bigint").alias(out))


def expand_copies(df: DataFrame, copies: str, out: str, chunk: int = COPY_CHUNK) -> DataFrame:
    """One row per copy, numbered from 0 in ``out``; rows without copies go.
    Two short explodes, so no array grows with the number of copies."""
    n = F.col(copies).cast("bigint")
    chunks = df.where(n > 0).withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(chunk).cast("bigint"))))
    last = F.least(F.col("_from") + chunk, n) - 1
    return chunks.withColumn(out, F.explode(F.sequence(F.col("_from"), last))).drop("_from")
