"""Event patterns over an ordered key: steps that may be optional, repeated, or
guarded by kinds that must not occur in between, within a time.

A pattern is a small automaton over event kinds.  For every event that can begin
a match, the end of its earliest match is wanted, which depends only on the
events after it: going through a key backwards in time, each state of the
automaton has a known "earliest end if it is here now", and one event changes
these by its transitions.  That vector is all a scan carries, and the summary of
a range of events is a map from states at its end to what becomes of them.

Keys are cut into ranges of rows (``plans.scan``), so a key may hold any share
of the events: ranges are scanned side by side, their maps are composed along
each key (a row a range), and events whose match ends in a later range look it
up.  ``within`` is compared at the end and needs no timers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstream.plans.scan import PART, ordered

#: States of a pattern's automaton, at most (a pattern of n steps has few more than n).
MAX_STATES = 64


@dataclass(frozen=True)
class Step:
    """One event of ``kind``; ``optional`` may be left out, ``repeated`` comes once
    or more; between the step before and this one no event of ``without`` lies
    (nor between its own repeats)."""
    kind: str
    optional: bool = False
    repeated: bool = False
    without: tuple[str, ...] = ()


def automaton(steps: Sequence[Step]) -> tuple[list[str], list[list[int]], int]:
    """(kinds, transitions[state][kind], state behind the first step's event);
    states -1 (no match any more) and -2 (matched).  The last kind stands for
    all others, which change nothing.

    Position p means that step p has just been taken.  An event of another kind
    leaves a position as it is, unless every way on from it forbids the kind.
    """
    if not steps or steps[0].optional or any(s.optional for s in steps[-1:]):
        raise ValueError("a pattern begins and ends with a step that is not optional")
    kinds = sorted({s.kind for s in steps} | {k for s in steps for k in s.without})
    last = len(steps) - 1

    def ways(p):  # steps that may come next
        out = [p] if steps[p].repeated else []
        for q in range(p + 1, len(steps)):
            out.append(q)
            if not steps[q].optional:
                break
        return out

    # An element is (position, steps that may still come next): a forbidden kind closes some of them.
    def after(elements, kind):
        out = set()
        for p, open_ in elements:
            for q in open_:
                if steps[q].kind == kind:
                    out.add((q, tuple(ways(q))))
            still = tuple(q for q in open_ if kind not in steps[q].without)
            if still:
                out.add((p, still))
        return frozenset(out)

    def name(elements):
        if any(p == last for p, _ in elements):
            return -2
        return number.setdefault(elements, len(number)) if elements else -1

    number: dict[frozenset, int] = {}
    first = name(frozenset({(0, tuple(ways(0)))}))
    table: list[list[int]] = []
    while len(table) < len(number):
        if len(number) > MAX_STATES:
            raise ValueError(f"the pattern needs more than {MAX_STATES} states")
        here = list(number)[len(table)]
        table.append([name(after(here, k)) for k in kinds] + [len(table)])
    return kinds, table, first


def _scan(table: list[list[int]], first: int, begins: int) -> object:
    """Rows (key, part, at, number of the kind) by part, key and falling time ->
    starts with the end of their match or the state they leave the range in, and
    one row a (part, key) with the range's map."""
    # An end is a time, or ~state for "as that state fares in the next range", or None.
    fresh = [~s for s in range(len(table))]

    def moved(ends, symbol, at):
        row = [table[s][symbol] for s in range(len(table))]
        return [at if t == -2 else None if t == -1 else ends[t] for t in row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends = None, None
        for batch in batches:
            out: list[tuple] = []
            for k, part, at, symbol in zip(*(c.to_pylist() for c in batch.columns)):
                if ends is None or (k, part) != key:
                    if ends is not None:
                        out.append((*key, None, None, None, ends))
                    key, ends = (k, part), fresh
                if symbol == begins:
                    # a first step that is also the last one matches at once
                    end = at if first == -2 else ends[first]
                    if end is not None:
                        out.append((k, part, at, end if end >= 0 else None, ~end if end < 0 else None, None))
                ends = moved(ends, symbol, at)
            yield batch_of(out, batch)
        if ends is not None:
            yield batch_of([(*key, None, None, None, ends)], batch)

    def batch_of(rows, batch):
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds_ = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds_)],
                                          ["key", "part", "at", "end", "state", "map"])
    return run


def match_pattern(events: DataFrame, steps: Sequence[Step], within: str | None = None, key: str = "user_id",
                  ts: str = "timestamp", kind: str = "event_type", tiebreak: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """-> (key, match_start, match_end): of every event of the first step's kind,
    its earliest match, if it ends ``within`` (an interval) of its start.

    Events are taken in order of (ts, tiebreak, kind), ``tiebreak`` being numbers; a match picks events for the
    steps in that order, skipping others, such that no skipped event between two
    picked ones is of a kind that the later one's step is ``without``.  Events
    without key, time or kind take no part.  Times are positive (after 1970).
    """
    kinds, table, first = automaton(steps)
    used = events.where(F.col(kind).isin(kinds) & F.col(key).isNotNull() & F.col(ts).isNotNull())
    ties = [f"tie{i}" for i in range(len(tiebreak))]
    symbol = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind)) - 1
    rows = used.select(F.col(key).alias("key"), (-F.unix_micros(ts)).alias("back"), *[(-F.col(c)).alias(t) for c, t in zip(tiebreak, ties)],
                       (-symbol).cast("int").alias("symbol"))
    rows = ordered(rows, ["key"], ["back", *ties, "symbol"], ranges)
    type_ = rows.schema["key"].dataType.simpleString()
    found = rows.select("key", PART, (-F.col("back")).alias("at"), (-F.col("symbol")).alias("symbol")).mapInArrow(
        _scan(table, first, kinds.index(steps[0].kind)), f"key {type_}, part bigint, at bigint, end bigint, state int, map array<bigint>").checkpoint()
    starts, maps = found.where(F.col("map").isNull()).drop("map"), found.where(F.col("map").isNotNull()).select("key", "part", "map")
    # What each state at the end of a range comes to: parts rise as time falls, so
    # the maps of the parts before are composed, the nearest one last.
    settled = maps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("all")) \
                  .where(F.size("all") > 1)  # a row a range of one key, at most as many as there are ranges
    nothing = F.array_repeat(F.lit(None).cast("bigint"), len(table))

    def step(acc, x):
        here = F.transform(x["map"], lambda e: F.when(e >= 0, e).otherwise(F.get(acc["ends"], (-e - 1).cast("int"))))
        return F.struct(here.alias("ends"), F.concat(acc["out"], F.array(F.struct(x["part"].alias("part"), acc["ends"].alias("later")))).alias("out"))

    empty = F.array().cast("array<struct<part:bigint,later:array<bigint>>>")
    later = settled.select("key", F.explode(F.aggregate("all", F.struct(nothing.alias("ends"), empty.alias("out")), step, lambda a: a["out"])).alias("x")) \
                   .select(F.col("key").alias("_key"), F.col("x.part").alias("_part"), F.col("x.later").alias("later"))
    done = starts.where(F.col("end").isNotNull()).select("key", "at", "end")
    open_ = starts.where(F.col("end").isNull()).join(later, (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_part"))) \
                  .select("key", "at", F.get("later", F.col("state")).alias("end")).where(F.col("end").isNotNull())
    out = done.unionByName(open_).select(F.col("key").alias(key), F.timestamp_micros("at").alias("match_start"),
                                         F.timestamp_micros("end").alias("match_end"))
    return out if within is None else out.where(F.col("match_end") <= F.col("match_start") + F.expr(f"INTERVAL {within}"))
