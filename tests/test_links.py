"""Ordered mutation replay: brute force, a hot id, and the end-to-end scenario."""

import contextlib
import datetime as dt
import random

from pyspark.sql import functions as F

from linkstream.operators import links as L
from linkstream.operators.rollup import hourly_rollup
from linkstream.operators.toplinks import top_links_enriched
from linkstream.sources import fixtures as FX
from linkstream.sources.tables import Tables
from tests.conftest import SF001, SF01


def fold(rows, initial=None):
    """Sequential reference: the guards applied one mutation at a time."""
    state = dict(initial or {})
    applied, rejected = set(), {}
    for r in sorted(rows, key=lambda r: (r["commit_ts"], r["seq"])):
        cur = state.get(r["id"])
        key = (r["id"], r["seq"])
        if r["op"] == "insert":
            if cur is None:
                state[r["id"]] = {"long_url": r["long_url"], "user_id": r["user_id"], "created_at": r["commit_ts"]}
                applied.add(key)
            else:
                rejected[key] = "already_exists"
        else:
            if cur is None:
                rejected[key] = "not_found"
            elif r["user_id"] is None or r["user_id"] != cur["user_id"]:
                rejected[key] = "not_owner"
            else:
                applied.add(key)
                if r["op"] == "update":
                    cur["long_url"] = r["long_url"]
                else:
                    del state[r["id"]]
    return state, applied, rejected


@contextlib.contextmanager
def unsplit(spark, joined):
    """AQE joins small ranges into one; without it every range stays apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(joined).lower())
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _check(spark, muts_df):
    rows = [r.asDict() for r in muts_df.collect()]
    state, applied, rejected = fold(rows)
    final, app, rej = L.apply_mutations(None, muts_df)
    got_final = {r.id: (r.long_url, r.user_id, r.created_at) for r in final.collect()}
    assert got_final == {k: (v["long_url"], v["user_id"], v["created_at"]) for k, v in state.items()}
    assert {(r.id, r.seq) for r in app.collect()} == applied
    assert {(r.id, r.seq): r.reason for r in rej.collect()} == rejected


def test_replay_matches_sequential_fold(spark):
    _check(spark, FX.link_mutations(Tables(spark, SF001)))


def test_replay_counts_sf001(spark):
    final, app, rej = L.apply_mutations(None, FX.link_mutations(Tables(spark, SF01)))
    assert (final.count(), app.count(), rej.count()) == (858, 6084, 8916)


def test_hot_id_many_lives(spark):
    """One id holds most of the log and lives many times; chunked and
    unchunked scans must agree with the fold."""
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        hot = i % 3 != 0
        rows.append(("HOT" if hot else f"k{i % 17}", rnd.choice(["insert", "update", "delete", "delete"]),
                     f"u{i}", rnd.choice(["a", "b", None]) if hot else rnd.choice(["a", "b"]),
                     base + dt.timedelta(hours=rnd.randrange(0, 24 * 90)), i))
    df = spark.createDataFrame(rows, "id string, op string, long_url string, user_id string, commit_ts timestamp, seq long")
    _check(spark, df)
    with unsplit(spark, False):  # the hot id lies in several ranges
        _check(spark, df)


def test_scenario_create_click_update_delete(spark):
    """create slug -> 5 clicks -> in top links and history -> update ->
    new URL, same place in history -> delete -> gone from both."""
    t0 = dt.datetime(2026, 3, 14, 12, 0, 0)
    muts = [("myslug", "insert", "https://a.example", "alice", t0, 1)]
    clicks = spark.createDataFrame([(t0 + dt.timedelta(seconds=i), "myslug", "US") for i in range(5)],
                                   "event_time timestamp, short_code string, country_code string")
    roll = hourly_rollup(clicks)

    def state(ms):
        df = spark.createDataFrame(ms, "id string, op string, long_url string, user_id string, commit_ts timestamp, seq long")
        return L.apply_mutations(None, df)[0]

    links = state(muts)
    top = top_links_enriched(roll, links).collect()
    assert [(r.short_code, r.long_url, r.total_clicks) for r in top] == [("myslug", "https://a.example", 5)]
    assert [r.id for r in L.user_history(links, "alice").collect()] == ["myslug"]
    muts.append(("myslug", "update", "https://b.example", "mallory", t0 + dt.timedelta(minutes=1), 2))  # not owner
    muts.append(("myslug", "update", "https://c.example", "alice", t0 + dt.timedelta(minutes=2), 3))
    links = state(muts)
    hist = L.user_history(links, "alice").collect()
    assert [(r.id, r.long_url, r.created_at) for r in hist] == [("myslug", "https://c.example", t0)]
    assert top_links_enriched(roll, links).collect()[0].long_url == "https://c.example"
    muts.append(("myslug", "delete", None, "alice", t0 + dt.timedelta(minutes=3), 4))
    links = state(muts)
    assert top_links_enriched(roll, links).count() == 0
    assert L.user_history(links, "alice").count() == 0


def test_links_as_of_is_snapshot(spark):
    log = FX.link_mutations(Tables(spark, SF001))
    early = L.links_as_of(log, "1993-01-01 00:00:00")
    assert early.where(F.col("updated_at") > F.lit("1993-01-01 00:00:00").cast("timestamp")).count() == 0


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

MUTS = "id string, op string, long_url string, user_id string, commit_ts timestamp, seq long"
_EVENT = st.tuples(st.sampled_from(["k0", "k1", "k2"]), st.sampled_from(["insert", "update", "delete"]),
                   st.sampled_from(["a", "b", None]), st.integers(min_value=0, max_value=40))


@settings(max_examples=6, deadline=None)
@given(st.lists(_EVENT, min_size=1, max_size=60), st.booleans())
def test_replay_property(spark, events, cut):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, op, f"u{i}", user, base + dt.timedelta(hours=6 * day), i)
            for i, (k, op, user, day) in enumerate(events)]
    df = spark.createDataFrame(rows, MUTS)
    with unsplit(spark, not cut):
        _check(spark, df)


def test_equal_commit_time_and_seq(spark):
    """Two inserts of an id at one (commit_ts, seq): one wins, the other is
    rejected; exact copies and rows without id are rejected too."""
    t = dt.datetime(2024, 1, 1)
    rows = [("x", "insert", "u2", "bob", t, 1), ("x", "insert", "u1", "amy", t, 1),
            ("y", "insert", "u", "amy", t, 1), ("y", "insert", "u", "amy", t, 1), (None, "insert", "u", "amy", t, 1)]
    final, applied, rejected = L.apply_mutations(None, spark.createDataFrame(rows, MUTS))
    assert sorted((r.id, r.long_url, r.user_id) for r in final.collect()) == [("x", "u1", "amy"), ("y", "u", "amy")]
    assert applied.count() == 2
    assert {r.reason for r in rejected.collect()} == {"already_exists"} and rejected.count() == 3
