"""Scaling check: the events table replicated k times (Spark derives the
copies from the given table; every copy keeps its user ids, so hot codes
get hotter) and the flagship read path, the roll-up and sessions timed at
each factor.  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 SCALES=1,10,50 python bench_scaling.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import functions as F

    from linkstream.operators import patterns as PT
    from linkstream.operators import rollup as R
    from linkstream.operators import toplinks as TL
    from linkstream.session import get_spark
    from linkstream.sources import fixtures as FX
    from linkstream.sources.tables import Tables

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    scales = [int(x) for x in os.environ.get("SCALES", "1,10,50").split(",")]
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", app="linkstream-scaling", shuffle_partitions=int(cpus) * 4,
                      extra={"spark.driver.memory": "16g"})

    def timed(df) -> float:
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t0, 3)

    out = {}
    for k in scales:
        t = Tables(spark, sf_dir)
        base = t("events")
        copy = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_copy")
        scaled = (base.select("*", copy)
                      .withColumn("event_id", F.col("event_id") + F.col("_copy").cast("bigint") * F.lit(1_000_000_000))
                      .drop("_copy"))
        t._cache["events"] = scaled
        clicks = FX.clicks(t)
        runs = {
            "hourly_rollup": lambda: R.hourly_rollup(clicks),
            "top_links_enriched": lambda: TL.top_links_enriched(R.hourly_rollup(clicks), FX.url_mappings(t), 10),
            "sessions": lambda: PT.sessions(FX.user_events(t), "user_id", "timestamp", 1800),
        }
        for name, build in runs.items():
            timed(build())                       # warm-up at this size
            out.setdefault(name, {})[k] = timed(build())
        out.setdefault("events_rows", {})[k] = scaled.count()
    print(json.dumps({"metric": "scaling", "sf": os.path.basename(sf_dir).removeprefix("sf"), "seconds": out}))
    spark.stop()


if __name__ == "__main__":
    main()
