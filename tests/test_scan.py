"""Ordered scans over ranges equal one window per key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkstream.plans.ranking import global_row_number
from linkstream.plans.scan import PART, ordered, scan_last, scan_sum
from linkstream.sources.tables import Tables
from tests.conftest import SF01


def _events(spark):
    e = Tables(spark, SF01)("events")
    # user 0 made hot: a third of all rows share one key
    return e.withColumn("k", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))


def _same(a, b):
    a = a.select(*b.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _window(direction="prev", hi=-1):
    by = F.asc if direction == "prev" else F.desc
    return Window.partitionBy("k").orderBy(by("ts"), by("event_id")).rowsBetween(Window.unboundedPreceding, hi)


def test_scan_last_equals_one_window_per_key(spark):
    e = _events(spark).select("k", "ts", "event_id", "value")
    cut = ordered(e, ["k"], ["ts", "event_id"], ranges=7)
    v = F.when(F.col("event_id") % 4 == 0, F.col("value"))
    for direction in ("prev", "next"):
        for inclusive in (False, True):
            b = e.withColumn("out", F.last(v, ignorenulls=True).over(_window(direction, 0 if inclusive else -1)))
            _same(scan_last(cut, ["k"], v, "out", direction, inclusive), b)


def test_scan_sum_equals_one_window_per_key(spark):
    e = _events(spark).select("k", "ts", "event_id")
    p = (F.col("event_id") % 2 == 0).cast("int")
    a = scan_sum(ordered(e, ["k"], ["ts", "event_id"], ranges=7), ["k"], p, "n", total="all")
    b = e.withColumn("n", F.sum(p).over(_window(hi=0))).withColumn("all", F.sum(p).over(Window.partitionBy("k")))
    _same(a, b)
    _same(a.drop("all"), b.drop("all"))


def test_hot_key_inside_one_day_is_cut(spark):
    """A third of all rows on one key within one day: no range holds them all,
    and a finer key (key, value) still scans right."""
    e = (_events(spark).select("k", "ts", "event_id", "value")
         .withColumn("ts", F.when(F.col("k") == 0, F.lit("2024-01-01").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, event_id / 1000)"))
                            .otherwise(F.col("ts"))))
    cut = ordered(e, ["k"], ["ts", "event_id"], ranges=8)
    hot = cut.where("k = 0").groupBy(PART).count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < sum(r["count"] for r in hot) * 0.7
    assert cut.groupBy(PART).count().agg(F.max("count")).first()[0] < e.count() / 3
    fine = scan_last(cut.withColumn("g", F.col("event_id") % 3), ["k", "g"], F.col("event_id"), "out")
    w = Window.partitionBy("k", "g").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    _same(fine, e.withColumn("g", F.col("event_id") % 3).withColumn("out", F.last("event_id").over(w)))


def test_scans_of_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, t int")
    got = scan_sum(ordered(df, ["k"], ["t"]), ["k"], F.lit(1), "n", total="all")
    assert sorted((r.k or "", r.t, r.n, r["all"]) for r in got.collect()) == [("", 1, 1, 2), ("", 2, 2, 2), ("a", 3, 1, 1)]
    assert scan_last(ordered(df.limit(0), ["k"], ["t"]), ["k"], F.col("t"), "p").count() == 0


def test_global_row_number_dense(spark):
    e = Tables(spark, SF01)("events").select("event_id")
    r = global_row_number(e, [F.col("event_id").desc()], out="rn", start=1, partitions=7)
    rows = r.orderBy(F.col("event_id").desc()).collect()
    assert [x.rn for x in rows] == list(range(1, len(rows) + 1))


def test_exact_quantiles_match_percentile(spark):
    from linkstream.plans.ranking import exact_quantiles
    e = _events(spark).select("k", "value")
    got = exact_quantiles(e, ["k"], "value", [0.0, 0.5, 0.9, 0.99, 1.0], ["q0", "q50", "q90", "q99", "q100"])
    ref = e.groupBy("k").agg(F.percentile("value", [0.0, 0.5, 0.9, 0.99, 1.0]).alias("r"))
    j = got.join(ref, "k")
    assert j.count() == ref.count()
    for i, n in enumerate(["q0", "q50", "q90", "q99", "q100"]):
        assert j.where(F.abs(F.col(n) - F.col("r")[i]) > 1e-9).count() == 0, n


def test_exact_quantiles_null_group(spark):
    from linkstream.plans.ranking import exact_quantiles
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    got = {r.g: r.q50 for r in exact_quantiles(df, ["g"], "v", [0.5], ["q50"]).collect()}
    assert got == {None: 2.0, "a": 2.0}
