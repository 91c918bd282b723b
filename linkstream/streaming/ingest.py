"""Click ingest streams.

Hourly roll-up (the flagship write path) is *stateless*: each micro-batch
is parsed and reduced to partial counts written under ``batch_id=N``;
readers sum the partials.  No watermark sits in front of it, so a late
click is never dropped (a watermarked 1-hour window would drop rows that
arrive after the window closed; the original accepts any lateness).
Exactly-once comes from the checkpoint (offsets + commit log) plus the
idempotent per-batch overwrite in the sink.  Folders that a compaction has
folded in are removed by the next one, so their number does not grow.

The dashboard feed keeps running totals as state and publishes versions behind
a pointer: a batch costs what it holds, and a reader always finds a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructType

from linkstream.constants import CLICK_WATERMARK, DASHBOARD_REFRESH, TOP_LINKS_N
from linkstream.functions.timefns import ts_literal
from linkstream.operators.clicks import parse_clicks, publish_created, route_clicks
from linkstream.operators.rollup import ROLLUP_KEY, merged_visitors
from linkstream.operators.toplinks import best, enrich_top, top_links_json
from linkstream.schemas import HOURLY_PARTIAL, TOP_TOTAL
from linkstream.sources import files
from linkstream.sources.sinks import batch_dir, write_created_feed, write_known_codes, write_rollup, write_split


# Files of a compacted day, at most.
DAY_FILES = 16

# Without an explicit trigger: long enough that batch folders stay few (the
# original sink flushes every SINK_FLUSH_MS, into one table).
DEFAULT_TRIGGER = {"processingTime": "10 seconds"}


def _start(writer, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or DEFAULT_TRIGGER)).start()


def with_click_watermark(stream: DataFrame, delay: str = CLICK_WATERMARK, ts: str = "event_time") -> DataFrame:
    """Event time with bounded out-of-orderness.  Use only in front of the
    windowed alert / trend operators, never in front of the roll-up."""
    return stream.withWatermark(ts, delay)


_ROLLUP_COLS = HOURLY_PARTIAL.names


def init_rollup(spark: SparkSession, path: str) -> None:
    """Create the roll-up location (empty partial and compacted tables) if
    absent; ``ignore`` mode leaves an existing location untouched."""
    empty = spark.createDataFrame([], HOURLY_PARTIAL)
    empty.write.mode("ignore").parquet(f"{path}/partials/batch_id=-1")
    empty.write.mode("ignore").parquet(f"{path}/compacted/upto=-1/day=1970-01-01")
    # A version is there for readers once it has its folder here.
    spark.range(0).select(F.lit(True).alias("done")).write.mode("ignore").parquet(f"{path}/finished/upto=-1")


def _rollup_writer(path: str, compact_every: int | None, visitor: str | Column | None = None):
    """Write the batch's partial counts; every ``compact_every`` batches fold
    the batches before this one (all committed) into a compacted version."""
    write_partials = write_rollup(f"{path}/partials", visitor=visitor)

    def step(batch: DataFrame, batch_id: int) -> None:
        write_partials(batch, batch_id)
        if compact_every and batch_id > 0 and batch_id % compact_every == 0:
            compact_rollup_job(batch.sparkSession, path, batch_id - 1)
    return step


def stream_hourly_rollup(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                         value_col: str = "value", compact_every: int | None = None,
                         visitor: str | Column | None = None) -> StreamingQuery:
    """``visitor``: what tells visitors apart (a column of the parsed clicks); partials then carry their sketches."""
    init_rollup(stream.sparkSession, path)
    clicks, _ = parse_clicks(stream, value_col)
    return _start(clicks.writeStream.foreachBatch(_rollup_writer(path, compact_every, visitor)), checkpoint, trigger)


def _versions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    partials = spark.read.schema(StructType([*HOURLY_PARTIAL.fields]).add("batch_id", LongType())).parquet(f"{path}/partials")
    compacted = spark.read.schema(StructType([*HOURLY_PARTIAL.fields]).add("upto", LongType()).add("day", DateType())).parquet(f"{path}/compacted")
    finished = files.versions(spark, f"{path}/finished", "upto")  # a name a compaction still kept
    return partials, compacted.where(F.col("upto").isin(finished))


def _current_days(compacted: DataFrame) -> DataFrame:
    """For each day, the rows of the newest compacted version holding it."""
    newest = compacted.groupBy("day").agg(F.max("upto").alias("upto"))
    return compacted.join(newest, ["day", "upto"], "left_semi")


def read_rollup(spark: SparkSession, path: str, since: str | None = None, visitors: bool = False) -> DataFrame:
    """Partial rows visible to readers: per day the newest compacted version,
    plus every partial batch written after the newest compaction.  Sum them
    to get totals.  ``since``: only hours from this time on; other days of the
    compacted table are not read.  ``visitors``: with the visitor sketches."""
    cols = _ROLLUP_COLS if visitors else _ROLLUP_COLS[:-1]
    partials, compacted = _versions(spark, path)
    upto = compacted.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]
    newer = partials.where(F.col("batch_id") > F.lit(upto)).select(*cols)
    if since is None:
        return _current_days(compacted).select(*cols).unionByName(newer)
    wanted = _current_days(compacted.where(F.col("day") >= F.to_date(ts_literal(since))))
    return wanted.select(*cols).unionByName(newer).where(F.col("hour") >= ts_literal(since))


def compact_rollup_job(spark: SparkSession, path: str, upto_batch: int) -> None:
    """Merge partials of committed batches <= ``upto_batch`` into version
    ``upto_batch``, rewriting only the days those batches touched.

    ``upto_batch`` must be a committed batch id (e.g.
    ``query.lastProgress['batchId']``), so a batch still being replayed is
    never folded in.  A day untouched by the new batches keeps its older
    version, which readers still pick for it.  The new version becomes
    visible by its folder in ``finished``, written after all its days: a job that
    dies between days leaves nothing to readers, and its re-run overwrites
    what it left.  What the version before this one had already replaced is then
    removed; readers that began before this version still find all they need."""
    partials, compacted = _versions(spark, path)
    prev = compacted.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]
    if upto_batch <= prev:
        return  # already compacted (a re-run must not overwrite the version)
    fresh = (partials.where((F.col("batch_id") > F.lit(prev)) & (F.col("batch_id") <= F.lit(upto_batch)))
                     .select(*_ROLLUP_COLS).withColumn("day", F.to_date("hour")))
    touched = fresh.select("day").distinct()
    base = (_current_days(compacted).join(touched, "day", "left_semi")
                                    .select(*_ROLLUP_COLS, "day"))
    merged = (base.unionByName(fresh).groupBy("day", *ROLLUP_KEY)
                  .agg(F.sum("total_clicks").cast("bigint").alias("total_clicks"), merged_visitors().alias("visitors")))
    # Its groupBy shuffles by the whole key; a day's rows meet in a few tasks,
    # not in one file per task.
    spread = merged.repartition(F.col("day"), F.pmod(F.xxhash64("short_code"), F.lit(DAY_FILES)))
    spread.write.mode("overwrite").partitionBy("day").parquet(f"{path}/compacted/upto={upto_batch}")
    spark.range(0).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{path}/finished/upto={upto_batch}")
    _remove_replaced(spark, path, prev)


def _remove_replaced(spark: SparkSession, path: str, prev: int) -> None:
    """Remove the partials folded into version ``prev``, days that versions up to
    it replace, and versions without a day left.  Only folder names are read."""
    for batch_id in files.versions(spark, f"{path}/partials", "batch_id"):
        if 0 <= batch_id <= prev:
            files.remove(spark, f"{path}/partials/batch_id={batch_id}")
    replaced: set[str] = set()
    finished = set(files.versions(spark, f"{path}/finished", "upto"))
    for upto in reversed([v for v in files.versions(spark, f"{path}/compacted", "upto") if 0 <= v <= prev]):
        days = {d for d in files.names(spark, f"{path}/compacted/upto={upto}") if d.startswith("day=")}
        gone = days if upto not in finished else days & replaced
        for day in gone:
            files.remove(spark, f"{path}/compacted/upto={upto}/{day}")
        if not days - gone:
            files.remove(spark, f"{path}/compacted/upto={upto}")
            files.remove(spark, f"{path}/finished/upto={upto}") if upto != prev else None
        replaced |= days if upto in finished else set()


def stream_split_clicks(stream: DataFrame, paths: dict[str, str], checkpoint: str,
                        trigger: dict | None = None, value_col: str = "value") -> StreamingQuery:
    """Main / bot / reject outputs from one pass (side-output pattern)."""
    tagged = route_clicks(stream, value_col)
    return _start(tagged.writeStream.foreachBatch(write_split(paths)), checkpoint, trigger)


def dedup_stream(stream: DataFrame, keys: list[str], ts: str = "event_time",
                 delay: str = CLICK_WATERMARK) -> DataFrame:
    """Drop redelivered events; state is kept only within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def links_change_feed(applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applied mutations -> (created events, codes to add to the known set)."""
    inserts = applied.where(F.col("op") == "insert")
    created = publish_created(inserts, "id")
    known = inserts.select(F.col("id").alias("short_code")).distinct()
    return created, known


def stream_links_change_feed(applied_stream: DataFrame, path: str, checkpoint: str,
                             trigger: dict | None = None) -> StreamingQuery:
    """Both sides of the feed from one pass: created events under
    ``path/created``, new known codes under ``path/known`` (see ``read_known``)."""
    write_created, write_known = write_created_feed(f"{path}/created"), write_known_codes(f"{path}/known")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            created, known = links_change_feed(batch)
            write_known(known, batch_id)  # first, so that a created code is always known
            write_created(created, batch_id)
        finally:
            batch.unpersist()

    return _start(applied_stream.writeStream.foreachBatch(step), checkpoint, trigger)


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """The set of known codes of a change feed; batches may repeat a code."""
    return spark.read.parquet(f"{path}/known").select("short_code").distinct()


#: Published versions that are kept for readers that have just read the pointer.
KEPT_VERSIONS = 3


def stream_top_links(stream: DataFrame, links: DataFrame, path: str, checkpoint: str,
                     every: str = DASHBOARD_REFRESH, n: int = TOP_LINKS_N,
                     value_col: str = "value", trigger: dict | None = None) -> StreamingQuery:
    """Dashboard feed: the enriched top-n of all clicks so far, a version a batch.

    Totals per code are state of the stream, and a batch brings those that it
    changed.  Totals only grow, so the new top-n lies among the one before and
    the changed codes: nothing else is read.  A version is written whole, then
    the pointer is moved to it by a rename; a replayed batch finds its version
    published and leaves it.  ``read_top_links`` reads the current one.
    """
    clicks, _ = parse_clicks(stream, value_col)
    totals = clicks.groupBy("short_code").agg(F.count(F.lit(1)).alias("total_clicks"))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = files.published(spark, f"{path}/CURRENT")
        if current is not None and int(current) >= batch_id:
            batch.write.format("noop").mode("overwrite").save()  # its state is committed by reading it
            return
        changed = batch.select("short_code", "total_clicks")
        if current is not None:
            before = spark.read.schema(TOP_TOTAL).parquet(f"{path}/totals/version={current}")
            changed = changed.unionByName(before).groupBy("short_code").agg(F.max("total_clicks").alias("total_clicks"))
        best(changed, n).write.mode("overwrite").parquet(f"{path}/totals/version={batch_id}")
        top = spark.read.schema(TOP_TOTAL).parquet(f"{path}/totals/version={batch_id}").limit(n)
        top_links_json(enrich_top(top, links, n)).write.mode("overwrite").json(f"{path}/top_links/version={batch_id}")
        files.publish(spark, f"{path}/CURRENT", str(batch_id))
        for kind in ("totals", "top_links"):
            for old in files.versions(spark, f"{path}/{kind}", "version")[:-KEPT_VERSIONS]:
                files.remove(spark, f"{path}/{kind}/version={old}")

    writer = totals.writeStream.outputMode("update").foreachBatch(step)
    return _start(writer, checkpoint, trigger or {"processingTime": every})


def read_top_links(spark: SparkSession, path: str) -> DataFrame:
    """The published document (column ``json``); an empty one before the first."""
    current = files.published(spark, f"{path}/CURRENT")
    if current is None:
        return spark.createDataFrame([('{"top_links":[]}',)], "json string")
    return spark.read.schema("json string").json(f"{path}/top_links/version={current}")


__all__ = ["batch_dir", "compact_rollup_job", "dedup_stream", "links_change_feed", "read_known", "read_rollup",
           "read_top_links", "stream_hourly_rollup", "stream_links_change_feed", "stream_split_clicks", "stream_top_links",
           "with_click_watermark"]
