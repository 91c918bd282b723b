"""Global dense numbering without a single-partition window.

``Window.orderBy(...)`` with no partition pulls every row into one task.
Instead: range-partition and sort (a distributed sort), cut lineage so
partition contents are stable, count rows per partition (one tiny row
per partition), turn the counts into start offsets, and add the offset to
each row's index inside its partition.  Only the per-partition count
table is small enough to broadcast, and its size is the partition count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkstream.plans.scan import ordered, scan_sum

_ROW_BITS = 33  # monotonically_increasing_id: partition id << 33 | row index


def stable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (in spark.checkpoint.dir)."""
    return df.checkpoint(eager=True)


def global_row_number(df: DataFrame, order: list[Column], out: str = "row_number",
                      start: int = 1, partitions: int | None = None) -> DataFrame:
    """``out`` = start + position of the row in ``order`` (order must be total)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    sorted_df = stable(sorted_df.withColumn("_mid", F.monotonically_increasing_id()))
    with_pid = sorted_df.withColumn("_pid", F.shiftright("_mid", _ROW_BITS)) \
                        .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    counts = with_pid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the window below runs over `n` rows only.
    offsets = counts.select("_pid", (F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_off"))
    res = with_pid.join(F.broadcast(offsets), "_pid")
    return (res.withColumn(out, F.col("_off") + F.col("_idx") + F.lit(start))
               .drop("_mid", "_pid", "_idx", "_off"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (group keys may be NULL)."""
    ren = {k: f"_jr_{k}" for k in keys}
    r = right.select(*[F.col(c).alias(ren.get(c, c)) for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(ren[k])) for k in keys]
    return left.join(r, cond, how).drop(*ren.values())


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    names: list[str]) -> DataFrame:
    """Exact quantiles (linear interpolation, as ``percentile``) per group,
    without holding any group in one task.

    Equal values are counted first, so ties cost one row.  A running sum over
    a group's distinct values (``plans.scan``) gives the ranks that each value
    covers; the values at the ranks floor(h) and ceil(h) of a quantile,
    h = (n - 1) * p, are picked by a plain aggregate and interpolated.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    distinct = v.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = scan_sum(ordered(distinct, keys, ["_v"]), keys, F.col("_c"), "_upto", total="_n")

    def at(rank: Column) -> Column:  # the value that covers this rank from 0
        return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c")), F.col("_v")))

    h = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    picks = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *[
        at(side(x)).alias(f"_{name}{i}") for i, x in enumerate(h) for side, name in ((F.floor, "lo"), (F.ceil, "hi"))])
    # Same interpolation form as Spark's percentile.
    return picks.select(*keys, *[
        F.when(F.floor(x) == F.ceil(x), F.col(f"_lo{i}"))
         .otherwise((F.ceil(x) - x) * F.col(f"_lo{i}") + (x - F.floor(x)) * F.col(f"_hi{i}")).alias(n)
        for i, (x, n) in enumerate(zip(h, names))])
