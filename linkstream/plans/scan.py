"""Ordered per-key scans that stay parallel on a hot key.

A window ``partitionBy(key)`` sends a whole key to one task.  When one key
may hold a third of all rows that task is the job.  Here every key goes one
way, whatever its size:

1. ``ordered`` range-partitions and sorts the rows by (keys, order) and
   numbers them, so a key with many rows lies in several ranges and a burst
   in a short time is cut like any other run of rows;
2. a scan runs inside (range, key) with a window;
3. one summary row per (range, key) is scanned across the ranges of the key;
   the carried value is joined back.  Only keys in more than one range have
   one, and a cut between two ranges lies in one key at most.

Frames are always running frames (``unboundedPreceding .. -1/0``), which
Spark evaluates in one pass; "next" scans run over descending order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Place of a row in the total order, and the range that it lies in.
POS, PART = "_scan_pos", "_scan_part"
_ROW_BITS = 33  # monotonically_increasing_id: partition id << 33 | row index


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``POS`` and ``PART``, for scans over ``keys`` (or keys and
    more columns) by ``order``.  Rows equal in both get some fixed order.

    Checkpointed: the scans read the rows more than once, and the bounds of the
    ranges must not be drawn again in between.  Without ``ranges`` the session's
    shuffle partitions hold, and AQE joins small ones.
    """
    cols = [F.col(c) for c in [*keys, *order]]
    cut = df.repartitionByRange(ranges, *cols) if ranges else df.repartitionByRange(*cols)
    numbered = cut.sortWithinPartitions(*cols).withColumn(POS, F.monotonically_increasing_id())
    return numbered.withColumn(PART, F.shiftright(POS, _ROW_BITS)).checkpoint()


def _join_carry(local: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on (range, keys) with null-safe key equality."""
    ren = {k: f"_r_{k}" for k in [*keys, PART]}
    right = carried.select(*[F.col(c).alias(ren.get(c, c)) for c in carried.columns])
    cond = [F.col(k).eqNullSafe(F.col(ren[k])) for k in [*keys, PART]]
    return local.join(right, on=cond, how="left").drop(*ren.values())


def scan_last(df: DataFrame, keys: Sequence[str], value: Column, out: str,
              direction: str = "prev", inclusive: bool = False) -> DataFrame:
    """Add ``out`` = nearest non-null ``value`` before (``prev``) or after
    (``next``) each row within its key; ``inclusive`` also considers the row
    itself.  ``df`` comes from ``ordered``.
    """
    keys = list(keys)
    back = direction == "next"
    tmp, near, far, last = f"_{out}_v", f"_{out}_near", f"_{out}_far", f"_{out}_edge"
    by = (lambda c: F.col(c).desc()) if back else (lambda c: F.col(c).asc())
    df = df.withColumn(tmp, value)
    inside = Window.partitionBy(PART, *keys).orderBy(by(POS)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = df.withColumn(near, F.last(tmp, ignorenulls=True).over(inside))

    # The value of each range that its neighbour sees: the last one for prev,
    # the first one for next.
    edge = (F.min_by if back else F.max_by)(F.col(tmp), F.when(F.col(tmp).isNotNull(), F.col(POS)))
    summary = df.groupBy(PART, *keys).agg(edge.alias(last))
    across = Window.partitionBy(*keys).orderBy(by(PART)).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(PART, *keys, F.last(last, ignorenulls=True).over(across).alias(far)) \
                     .where(F.col(far).isNotNull())
    return (_join_carry(local, carried, keys).withColumn(out, F.coalesce(near, far)).drop(tmp, near, far))


def scan_sum(df: DataFrame, keys: Sequence[str], value: Column, out: str, total: str | None = None) -> DataFrame:
    """Add ``out`` = running sum (inclusive) of ``value`` (bigint, not null)
    within the key and, on demand, ``total`` = its sum over the whole key.
    ``df`` comes from ``ordered``."""
    keys = list(keys)
    tmp, near, before, n = f"_{out}_v", f"_{out}_near", f"_{out}_before", f"_{out}_n"
    df = df.withColumn(tmp, value.cast("bigint"))
    inside = Window.partitionBy(PART, *keys).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(near, F.sum(tmp).over(inside))
    across = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(PART, *keys).agg(F.sum(tmp).alias(n))
    if total:
        carried = carried.withColumn(total, F.sum(n).over(Window.partitionBy(*keys)))
    carried = carried.withColumn(before, F.sum(n).over(across)).drop(n)
    if not total:
        carried = carried.where(F.col(before).isNotNull())
    return (_join_carry(local, carried, keys).withColumn(out, F.col(near) + F.coalesce(before, F.lit(0)))
            .drop(tmp, near, before))


def scan_max(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add ``out`` = largest ``value`` among the rows before each row within its
    key (null before the first).  ``df`` comes from ``ordered``."""
    keys = list(keys)
    near, far, top = f"_{out}_near", f"_{out}_far", f"_{out}_top"
    inside = Window.partitionBy(PART, *keys).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn(near, F.max(value).over(inside))
    across = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = (df.groupBy(PART, *keys).agg(F.max(value).alias(top))
                 .select(PART, *keys, F.max(top).over(across).alias(far)).where(F.col(far).isNotNull()))
    return _join_carry(local, carried, keys).withColumn(out, F.greatest(near, far)).drop(near, far)
