"""Join building blocks.

Rule: ``broadcast()`` is written only for a side whose row count is bounded
by construction (the output of ``limit(n)``), and the bound is checked when
the plan is built.  Every other join is left to Spark: the optimizer
broadcasts a side only when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise plans a shuffle
(sort-merge) join, which AQE can still demote to a broadcast or split for
skew at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BOUNDED_BROADCAST_ROWS = 100_000


def bounded(n: int) -> int:
    """``n`` of a ranked ``limit(n)``, whose rows are numbered in one task and
    broadcast: an ``n`` above the bound is an error."""
    if n > MAX_BOUNDED_BROADCAST_ROWS:
        raise ValueError(f"a ranking of {n} rows: at most {MAX_BOUNDED_BROADCAST_ROWS}; "
                         "use plans.ranking.global_row_number for more")
    return n


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast-hint ``df``, the output of a ``limit(max_rows)``."""
    bounded(max_rows)
    return F.broadcast(df)


# Stored link tables are partitioned by a hash bucket of the id.  A join that
# also matches the bucket lets dynamic partition pruning reuse the broadcast
# side and read only the partitions of the keys it holds: enriching the top
# n codes then reads at most n partitions instead of the whole table.
LINK_BUCKETS = 1024
BUCKET_COL = "id_bucket"


def key_bucket(col, buckets: int = LINK_BUCKETS):
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.xxhash64(c), F.lit(buckets))


def join_links(keys: DataFrame, key_col: str, links: DataFrame, how: str = "inner",
               buckets: int | None = None) -> DataFrame:
    """Join ``keys`` to a link table on ``key_col = id``; when the table is
    stored bucketed (``id_bucket`` partition column, ``buckets`` given) the
    bucket is matched too, so partitions without those keys are pruned."""
    cond = keys[key_col] == links["id"]
    if buckets is not None and BUCKET_COL in links.columns:
        keys = keys.withColumn("_kb", key_bucket(key_col, buckets))
        cond = (keys[key_col] == links["id"]) & (keys["_kb"] == links[BUCKET_COL])
        return keys.join(links, cond, how).drop("_kb", BUCKET_COL)
    return keys.join(links, cond, how)


# Buckets of the hash that ``skew_safe_join`` also matches.
SKEW_BUCKETS = 1 << 16


def skew_safe_join(many: DataFrame, few: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join of ``many`` rows to a reduced side with a row a key, so that a
    hot key of ``many`` can be split at run time.

    Spark splits a skewed partition only if both sides of the join are plain
    exchanges.  ``few`` usually ends in an aggregate or a join by the key and is
    not exchanged again.  Matching a hash of the key as well asks both sides for
    another partitioning, which costs one more shuffle of the reduced side.
    """
    def bucket():
        return F.pmod(F.xxhash64(key), F.lit(SKEW_BUCKETS))

    return many.withColumn("_skew", bucket()).join(few.withColumn("_skew", bucket()), [key, "_skew"], how).drop("_skew")
