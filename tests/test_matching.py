"""Event patterns against a search through every event sequence."""

import random

import pytest
from pyspark.sql import functions as F

from linkstream.operators.matching import Step, automaton, match_pattern

PATTERNS = [
    [Step("a"), Step("b")],
    [Step("a"), Step("b", optional=True), Step("c")],
    [Step("a"), Step("b", repeated=True), Step("c", without=("d",))],
    [Step("a", repeated=True), Step("b", optional=True, without=("c",)), Step("a"), Step("d", without=("b",))],
    [Step("a"), Step("b", optional=True, repeated=True, without=("d",)), Step("c", without=("a", "d"))],
    [Step("a")],
]


def earliest(steps, kinds, i):
    """Least j such that events i..j hold a match that begins at i, by trying every choice."""
    last = len(steps) - 1
    here = {(0, i)}  # (step just taken, its event)
    if last == 0:
        return i
    reached = set()
    while here:
        p, at = here.pop()
        nexts = [p] if steps[p].repeated else []
        for q in range(p + 1, len(steps)):
            nexts.append(q)
            if not steps[q].optional:
                break
        for q in nexts:
            for j in range(at + 1, len(kinds)):
                if kinds[j] == steps[q].kind and (q, j) not in reached:
                    reached.add((q, j))
                    here.add((q, j))
                if kinds[j] in steps[q].without:
                    break
    ends = [j for q, j in reached if q == last]
    return min(ends) if ends else None


def brute(rows, steps, within):
    out = []
    by = {}
    for user, at, kind in rows:
        by.setdefault(user, []).append((at, kind))
    for user, events in by.items():
        events.sort()
        kinds = [k for _, k in events]
        for i, (at, k) in enumerate(events):
            if k == steps[0].kind and (j := earliest(steps, kinds, i)) is not None and events[j][0] - at <= within:
                out.append((user, at, events[j][0]))
    return sorted(out)


@pytest.mark.parametrize("steps", PATTERNS)
def test_matches_against_every_choice(spark, steps):
    rng = random.Random(len(steps))
    # one user holds most events, and is cut into ranges
    rows = [(0 if rng.random() < .6 else rng.randrange(1, 9), 10 * i + 1, rng.choice("abcdx")) for i in range(700)]
    df = spark.createDataFrame(rows, "user_id int, t bigint, event_type string").withColumn("timestamp", F.timestamp_seconds("t"))
    for within in (100, 10_000):
        got = match_pattern(df, steps, f"{within} SECONDS", ranges=7)
        got = sorted((r["user_id"], int(r["s"]), int(r["e"])) for r in got.select(
            "user_id", F.unix_seconds("match_start").alias("s"), F.unix_seconds("match_end").alias("e")).collect())
        assert got == brute(rows, steps, within)


def test_hot_key_is_cut(spark):
    df = spark.range(5000).select(F.lit(1).alias("user_id"), F.timestamp_seconds(F.col("id") + 1).alias("timestamp"),
                                  F.when(F.col("id") == 0, "a").when(F.col("id") == 4999, "c").otherwise("b").alias("event_type"))
    got = match_pattern(df, [Step("a"), Step("b", repeated=True), Step("c")], ranges=8).collect()  # through all ranges
    assert [(r["match_end"] - r["match_start"]).total_seconds() for r in got] == [4999]
    assert match_pattern(df, [Step("a"), Step("c", without=("b",))], ranges=8).count() == 0


def test_edges(spark):
    df = spark.createDataFrame([(None, 5, "a"), (1, None, "a"), (1, 5, None), (1, 6, "a"), (1, 6, "b"), (1, 6, "b")],
                               "user_id int, t bigint, event_type string").withColumn("timestamp", F.timestamp_seconds("t"))
    assert match_pattern(df, [Step("a"), Step("b")]).count() == 1  # equal times: by kind
    assert match_pattern(df.limit(0), [Step("a"), Step("b")]).count() == 0
    for bad in ([], [Step("a", optional=True), Step("b")], [Step("a"), Step("b", optional=True)]):
        with pytest.raises(ValueError):
            automaton(bad)
