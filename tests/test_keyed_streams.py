"""Streams with timers, versions, committed batches: restarts, late rows, failures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from linkstream.plans.registry import load_all
from linkstream.session import STATE_PROVIDER, scratch_path
from linkstream.sources import committed, files
from linkstream.sources import fixtures as FX
from linkstream.sources.streams import read_clicks_stream
from linkstream.sources.tables import Tables
from linkstream.streaming import alerts as AL
from linkstream.streaming import ingest as IN
from linkstream.streaming import keyed as KS
from tests.conftest import SF001
from tests.oracle_check import compare, duck_connection


def _local(path):
    return path.removeprefix("file:")


def test_timers_close_minutes_and_drop_late_rows(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("t-src", "t-out", "t-ck"))

    def run(seconds):
        rows = spark.createDataFrame([("k" if s >= 0 else "other", abs(s)) for s in seconds], "code string, s bigint")
        rows.select("code", F.timestamp_seconds("s").alias("event_time")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("code string, event_time timestamp").parquet(src)
        q = (KS.stream_bot_timers(stream, "code", threshold=3).writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
        got = sorted((r["code"], int(r["window_start"].timestamp()), r["kind"], r["events"]) for r in spark.read.parquet(out).collect())
        return q, got

    _, got = run([1, 50, 30, -20])
    assert got == []
    _, got = run([59, 58, 61, 2])  # a restart: the counts go on; the watermark stands at 45, so 2 is late
    assert got == [("k", 0, "crossed", 4)]
    _, got = run([3, 130])  # the watermark passes the first minute
    assert got == [("k", 0, "closed", 5), ("k", 0, "crossed", 4)]
    q, got = run([5, 6, 7, 8, 9, 140])  # too late for it
    assert got == [("k", 0, "closed", 5), ("k", 0, "crossed", 4)] and AL.dropped_by_watermark(q) >= 5


def test_a_hot_key_of_a_batch_is_read_row_by_row(spark):
    """The processor never holds a key's rows: it takes them from an iterator."""
    src, out, ck = (scratch_path(spark, n) for n in ("h-src", "h-out", "h-ck"))
    spark.range(60_000).select(F.lit("hot").alias("code"), F.timestamp_seconds(F.col("id") % 60).alias("event_time")).write.parquet(src)
    stream = spark.readStream.schema("code string, event_time timestamp").parquet(src)
    (KS.stream_bot_timers(stream, "code").writeStream.format("parquet").option("path", out)
       .option("checkpointLocation", ck).trigger(availableNow=True).start()).awaitTermination()
    assert [(r["kind"], r["events"]) for r in spark.read.parquet(out).collect()] == [("crossed", 101)]


def test_dashboard_reader_always_finds_a_whole_document(spark, monkeypatch):
    t = Tables(spark, SF001)
    src, path, ck = (scratch_path(spark, n) for n in ("d-src", "d-out", "d-ck"))
    msgs = FX.click_json(t)
    links = FX.url_mappings(t)
    msgs.repartition(6).write.json(src)
    assert json.loads(IN.read_top_links(spark, path).first()[0]) == {"top_links": []}
    seen, publish = [], files.publish

    def watched(spark_, at, value):  # what a reader finds while a new version lies there unpublished, and after
        before = json.loads(IN.read_top_links(spark_, path).first()[0])["top_links"]
        publish(spark_, at, value)
        seen.append((before, json.loads(IN.read_top_links(spark_, path).first()[0])["top_links"]))

    monkeypatch.setattr(files, "publish", watched)
    cfg = {"format": "json", "path": src, "schema": "event_id long, value string", "max_files_per_trigger": 1}
    q = IN.stream_top_links(read_clicks_stream(spark, cfg), links, path, ck, trigger={"availableNow": True})
    q.awaitTermination()
    assert len(seen) >= 6 and seen[0][0] == [] and all(a[1] == b[0] for a, b in zip(seen, seen[1:]))
    assert all(sum(x["total_clicks"] for x in b) >= sum(x["total_clicks"] for x in a) for a, b in seen[1:])
    for kind in ("totals", "top_links"):
        assert len(files.versions(spark, f"{path}/{kind}", "version")) <= IN.KEPT_VERSIONS
    # the last version equals the ranking of all clicks, and a replayed batch changes nothing
    from linkstream.operators.clicks import parse_clicks
    from linkstream.operators.rollup import hourly_rollup
    from linkstream.operators.toplinks import top_links_enriched, top_links_json
    want = top_links_json(top_links_enriched(hourly_rollup(parse_clicks(msgs)[0]), links)).first()[0]
    assert IN.read_top_links(spark, path).first()[0] == want
    files.remove(spark, f"{ck}/commits/{q.lastProgress['batchId']}")
    IN.stream_top_links(read_clicks_stream(spark, cfg), links, path, ck, trigger={"availableNow": True}).awaitTermination()
    assert IN.read_top_links(spark, path).first()[0] == want


def test_folders_of_the_rollup_stay_few(spark):
    t = Tables(spark, SF001)
    src, out, ck = (scratch_path(spark, n) for n in ("f-src", "f-out", "f-ck"))
    msgs = FX.click_json(t).where(F.col("event_id") % 50 != 0)
    msgs.repartition(14).write.json(src)
    cfg = {"format": "json", "path": src, "schema": "event_id long, value string", "max_files_per_trigger": 1}
    q = IN.stream_hourly_rollup(read_clicks_stream(spark, cfg), out, ck, {"availableNow": True}, compact_every=2)
    q.awaitTermination()
    assert IN.read_rollup(spark, out).agg(F.sum("total_clicks")).first()[0] == msgs.count()
    batches = files.versions(spark, f"{out}/partials", "batch_id")
    assert len(batches) <= 2 * 2 + 2, batches  # two compactions' batches, the empty one, the newest
    upto = files.versions(spark, f"{out}/compacted", "upto")
    assert files.versions(spark, f"{out}/finished", "upto")[-1] == upto[-1]
    days = [d for v in upto for d in files.names(spark, f"{out}/compacted/upto={v}") if d.startswith("day=")]
    # of each day its version, and one that the newest compaction replaced; a version without a current day is gone
    assert max(days.count(d) for d in days) <= 2 and all(v in (-1, *upto[-2:]) or any(
        n.startswith("day=") for n in files.names(spark, f"{out}/compacted/upto={v}")) for v in upto)


class _Failing(committed.CommittedWriter):
    """Its first task run fails after it has written its file."""

    def write(self, iterator):
        message = super().write(iterator)
        if not os.path.exists(self.path + "-failed"):
            open(self.path + "-failed", "w").close()
            raise RuntimeError("lost executor")
        return message


class _FailingSource(committed.CommittedSource):
    @classmethod
    def name(cls):
        return "linkstream-failing"

    def streamWriter(self, schema, overwrite):
        return _Failing(self.options)


def test_failed_tasks_and_replayed_batches_add_nothing(spark):
    src, out, ck = (_local(scratch_path(spark, n)) for n in ("c-src", "c-out", "c-ck"))
    spark.range(100).repartition(4).write.parquet(src)
    spark.dataSource.register(_FailingSource)

    def start(fmt):
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 2).parquet(src)
        return stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()

    with pytest.raises(Exception):
        start("linkstream-failing").awaitTermination()
    assert committed.read_committed(spark, out, "id bigint").count() == 0  # written, not committed
    spark.dataSource.register(committed.CommittedSource)
    q = start(committed.FORMAT)
    q.awaitTermination()
    assert sorted(r["id"] for r in committed.read_committed(spark, out, "id bigint").collect()) == [*range(100)]
    files.remove(spark, f"{ck}/commits/{q.lastProgress['batchId']}")  # the batch runs again
    start(committed.FORMAT).awaitTermination()
    assert sorted(r["id"] for r in committed.read_committed(spark, out, "id bigint").collect()) == [*range(100)]


def test_unknown_codes_come_out_with_the_watermark(spark):
    made_src, asked_src, out, ck = (scratch_path(spark, n) for n in ("g-made", "g-asked", "g-out", "g-ck"))

    def run(made, asked):
        spark.createDataFrame(made, "value string, t bigint").select("value", F.timestamp_seconds("t").alias("timestamp")) \
             .coalesce(1).write.mode("append").parquet(made_src)
        spark.createDataFrame(asked, "id int, short_code string, t bigint").select("id", "short_code", F.timestamp_seconds("t").alias("ts")) \
             .coalesce(1).write.mode("append").parquet(asked_src)
        found = AL.stream_known_code_guard(spark.readStream.schema("id int, short_code string, ts timestamp").parquet(asked_src),
                                           spark.readStream.schema("value string, timestamp timestamp").parquet(made_src), "1 HOUR")
        (found.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", ck)
              .trigger(availableNow=True).start()).awaitTermination()
        return {r["id"]: r["outcome"] for r in spark.read.parquet(out).collect()}

    assert run([("a", 10), ("z", 20)], [(1, "a", 15), (2, "b", 16), (3, "a", 5), (4, None, 17)]) == {
        1: None, 3: "url_not_found_bloom"}  # the watermark stands at 12: of 2, at 16, nothing is known yet
    got = run([("b", 18), ("z", 500)], [(5, "b", 30), (6, "z", 500)])  # b was made after request 2
    assert got[1] is None and got[5] is None and got[2] == got[3] == "url_not_found_bloom"


def test_kept_answers_expire(spark):
    import time
    src, out, ck = (scratch_path(spark, n) for n in ("k-src", "k-out", "k-ck"))

    def run(rows, ttl):
        spark.createDataFrame(rows, "id int, short_code string, table_url string").coalesce(1).write.mode("append").parquet(src)
        found = KS.stream_cached_lookups(spark.readStream.schema("id int, short_code string, table_url string").parquet(src), ttl=ttl)
        (found.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(once=True).start()).awaitTermination()
        return {r["id"]: r["source"] for r in spark.read.parquet(out).collect()}

    assert run([(1, "a", "u"), (2, "b", None), (3, "c", "")], "3 seconds") == {1: "db_stale", 2: "url_not_found_db", 3: "url_not_found_db"}
    time.sleep(4)
    got = run([(4, "a", "u"), (5, "b", "v")], "3 seconds")  # a has expired, b is there now
    assert got[4] == "db_stale" and got[5] == "db_stale"


def test_answers_are_kept_over_restarts(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("r-src", "r-out", "r-ck"))
    for i in range(3):
        spark.createDataFrame([(i, "a", "u")], "id int, short_code string, table_url string").write.mode("append").parquet(src)
        found = KS.stream_cached_lookups(spark.readStream.schema("id int, short_code string, table_url string").parquet(src), ttl="1 hour")
        (found.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(once=True).start()).awaitTermination()
    assert {r["id"]: r["source"] for r in spark.read.parquet(out).collect()} == {0: "db_stale", 1: "redis", 2: "redis"}


@pytest.mark.parametrize("name", ["stream_bot_timers", "stream_cached_lookups"])
def test_keyed_queries_run_on_a_session_with_the_default_store(spark, name):
    plain = spark.newSession()
    store = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    for k, v in ((STATE_PROVIDER, store), ("spark.sql.session.timeZone", "UTC"), ("spark.sql.shuffle.partitions", "4")):
        plain.conf.set(k, v)
    q = load_all()[name]
    n, problems = compare(plain, duck_connection(SF001), name, q.build, q.oracle, SF001)
    assert n and not problems, problems
    assert plain.conf.get(STATE_PROVIDER) == store


def test_lifetime_counts_keys_in_groups(spark):
    """Of many keys a batch makes few calls; keys that share one are counted apart, over restarts."""
    src, out, ck = (scratch_path(spark, n) for n in ("l-src", "l-out", "l-ck"))
    schema = "code bigint, id bigint, ts timestamp"
    big = 2**60

    def run(rows):
        spark.createDataFrame(rows, "code bigint, id bigint, t bigint").select(
            "code", "id", F.timestamp_seconds("t").alias("ts")).repartition(3).write.mode("append").parquet(src)
        q = (AL.stream_bot_lifetime(spark.readStream.schema(schema).parquet(src), "code", "ts", 2, tiebreak="id", groups=4)
               .writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
        df = spark.read.parquet(out)
        assert [f.dataType.typeName() for f in df.schema] == ["long", "long", "timestamp", "long"]
        return sorted((r["code"], r["id"], r["count"]) for r in df.where("code is not null").collect()), sorted(
            (r["id"] or 0, r["count"]) for r in df.where("code is null").collect())

    few = [(big + k, big + 1000 + k, 5) for k in range(300)]  # alike as floats; once each
    hot = [(big + 1, big + 1, 9), (big + 1, big + 2, 9), (big + 1, big + 3, 7)]  # a fourth one at 5, so 7, 9, 9 in order
    none = [(None, 1, 3), (None, 2, 2), (None, None, 9)]
    want = [(big + 1, big + 1, 3), (big + 1, big + 2, 4)]
    assert run(few + hot + none) == (want, [(0, 3)])
    assert run([(big + 2, big + 7, 1), (big + 2, big + 8, 1), (None, 4, 1)]) == (sorted([*want, (big + 2, big + 8, 3)]), [(0, 3), (4, 4)])


def test_timers_of_many_keys_share_entries(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("s-src", "s-out", "s-ck"))
    spark.range(300).select(F.when(F.col("id") % 3 > 0, F.floor(F.col("id") / 6) + 2**60).alias("code"),
                            F.timestamp_seconds(F.lit(5)).alias("event_time")).repartition(3).write.parquet(src)
    stream = spark.readStream.schema("code bigint, event_time timestamp").parquet(src)
    q = (KS.stream_bot_timers(stream, "code", threshold=3, groups=4).writeStream.format("parquet").option("path", out)
           .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5
    got = {(r["code"], r["kind"], r["events"]) for r in spark.read.parquet(out).collect()}
    assert got == {(k, "crossed", 4) for k in [None, *range(2**60, 2**60 + 50)]}
