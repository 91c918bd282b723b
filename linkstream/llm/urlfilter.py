"""URL filters: longest-match rules, then exact list membership by Bloom
filter cascades.

Level 0 encodes the listed keys.  Level 1 encodes the unlisted keys of the
corpus's complete key universe that level 0 lets through, level 2 the listed
keys that level 1 lets through, and so on until a level lets nothing wrong
through.  A key is then listed or not by the first level that turns it away,
with no error for any key of the universe and no join.

Rows are dealt by a hash of their keys into as many parts as keep the keys of
one small (``PART_SETS``), and each part has a cascade of its own, built in one
task from the part's universe.  The cascade then travels in front of the part's
rows, once for each of the tasks that share them, so neither the list nor the
universe has to fit anywhere whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, log, log2, sqrt
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstream.llm.common import free_name

#: Distinct key sets (hosts with their paths) of a part, as counted approximately.
PART_SETS = 500_000
#: False-positive rate of every level but the first.
LATER_RATE = 0.5
MAX_LEVELS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z in lower case; null
    and scheme-less urls have an empty host."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule], field: str) -> Column:
    """``field`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


class Level:
    """One Bloom filter: ``bits`` as 64-bit words, ``hashes`` probes a key."""

    def __init__(self, number: int, keys: int, rate: float):
        self.number = number
        self.hashes = max(1, round(log2(1 / rate)))
        self.words = max(1, ceil(keys * log(1 / rate) / log(2) ** 2 / 64))
        self.bits = np.zeros(0, np.uint64)

    def probes(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(self.hashes):
            x = h1 + np.uint64(self.number * 61 + i + 1) * (h2 | np.uint64(1))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            yield (x ^ (x >> np.uint64(29))) % np.uint64(self.words * 64)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in self.probes(h1, h2):
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, going = np.zeros(len(h1), bool), np.ones(len(h1), bool)
        for level in self.levels:
            even = level.number % 2 == 0
            through = level.has(h1, h2)
            out[going & ~through] = not even  # turned away by a level of the other side
            out[going & through] = even
            going &= through
        return out


def build(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> Cascade:
    """The cascade of one part's distinct keys."""
    n_listed, n_rest = int(listed.sum()), int((~listed).sum())
    levels: list[Level] = []
    rate = min(0.5, max(1e-9, sqrt(0.5) * n_listed / max(n_rest, 1)))
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two keys of the universe share 128 hash bits")
        level = Level(len(levels), len(inside), LATER_RATE if levels else rate)
        level.bits = np.zeros(level.words, np.uint64)
        for at in level.probes(h1[inside], h2[inside]):
            np.bitwise_or.at(level.bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        levels.append(level)
        # those wrongly let through are what the next level encodes
        inside, outside = outside[level.has(h1[outside], h2[outside])], inside
    return Cascade(levels)


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


def cascades(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """(part, key) rows and listed keys -> (part, cascade): a cascade exact on
    the part's keys, as bytes.  Nulls are no keys; listed keys outside the
    universe are not needed."""
    marks = universe.select("part", "key", F.lit(False).alias("l")).unionByName(
        listed.select(F.lit(None).cast("int").alias("part"), "key", F.lit(True).alias("l"))).where(F.col("key").isNotNull())
    # A key stands in as many parts as have rows with it, at most all.
    sides = marks.groupBy("key").agg(F.collect_set("part").alias("parts"), F.max("l").alias("listed")) \
                 .select(F.explode("parts").alias("part"), *key_hashes(F.col("key")), "listed")

    def one(group: tuple, keys: Any) -> Any:
        import pandas as pd
        c = build(keys.h1.to_numpy("i8").view("u8"), keys.h2.to_numpy("i8").view("u8"), keys.listed.to_numpy(bool))
        return pd.DataFrame({"part": [group[0]], "cascade": [pickle.dumps(c)]})

    return sides.groupBy("part").applyInPandas(one, "part int, cascade binary")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, cascade, row, h1, h2) by part, its cascade first -> (row, hit)."""
    part, cascade = None, Cascade([])
    for batch in batches:
        parts = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else []
        for a, b in zip(edges, [*edges[1:], len(parts)]):
            piece = batch.slice(a, b - a)
            if parts[a] != part:
                part, cascade = parts[a], Cascade([])  # a part without keys has no cascade
            sent = piece.column(1).is_valid()  # a copy for each of the part's salts that lie here
            if sent[0].as_py():
                cascade = pickle.loads(piece.column(1)[0].as_py())
            piece = piece.filter(pc.invert(sent))
            h1, h2 = piece.column(3), piece.column(4)
            sizes = pc.fill_null(pc.list_value_length(h1), 0).to_numpy(zero_copy_only=False)
            keys = [h.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for h in (h1, h2)]
            before = np.concatenate([[0], np.cumsum(cascade.listed(*keys))])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([piece.column(2), pa.array(before[ends] > before[ends - sizes])], ["row", "hit"])


def mark_any_listed(df: DataFrame, keys: str, out: str, listed: DataFrame, key: str) -> DataFrame:
    """``df`` plus the boolean column ``out``: whether any of its array ``keys``
    is listed.  The keys of all rows are the universe, and their cascades decide."""
    sets = df.select(F.approx_count_distinct(F.xxhash64(keys)).alias("n")).first()["n"]
    parts = max(1, -(-sets // PART_SETS))
    salts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts)
    routed = df.select(F.struct(*df.columns).alias("row"), F.col(keys).alias("keys"),
                       F.pmod(F.xxhash64(keys), F.lit(parts)).cast("int").alias("part"),
                       F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"))
    found = cascades(routed.select("part", F.explode("keys").alias("key")), listed.select(F.col(key).alias("key")))
    sent = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hashed = [F.transform("keys", lambda k: key_hashes(k)[i]).alias(f"h{i + 1}") for i in (0, 1)]
    stream = routed.select("part", "salt", F.lit(None).cast("binary").alias("cascade"), "row", *hashed).unionByName(sent, allowMissingColumns=True)
    dealt = stream.repartition(parts * salts, "part", "salt").sortWithinPartitions("part", "salt", F.col("cascade").isNull())
    hits = dealt.select("part", "cascade", "row", "h1", "h2").mapInArrow(_members, T.StructType([routed.schema["row"], T.StructField("hit", T.BooleanType())]))
    return hits.select("row.*", F.col("hit").alias(out))


def mark_listed(df: DataFrame, key: str, out: str, listed: DataFrame, listed_key: str | None = None) -> DataFrame:
    """``df`` plus the boolean column ``out``: whether its key is listed; a null key is not."""
    column, = free_name(df, "keys")
    one = df.withColumn(column, F.when(F.col(key).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col(key).cast("string"))))
    return mark_any_listed(one, column, out, listed, listed_key or key).drop(column)


def url_keys(host: Column, path: Column) -> Column:
    """The keys that list a url: its host, each label of it that a dot follows,
    with the dot, and host and path together."""
    labels = F.split(host, "[.]", -1)
    return F.array_distinct(F.concat(F.array(host, F.concat(host, path)),
                                     F.transform(F.slice(labels, 1, F.size(labels) - 1), lambda x: F.concat(x, F.lit(".")))))


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """-> (page_id, host, path, rule, verdict), a row per row.

    The longest rule that fits decides; else a page is blocked if it is in
    ``listed`` (column host), allowed if not.  A listed key is a host, a host with
    a path, or ``name.`` for every host with the label ``name`` before a dot.  A null url has an empty host
    and path, fits no rule, and is allowed unless the empty host is listed.
    Repeated rows are each answered; other columns are not read.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                         path_of(F.col(url_col)).alias("path"))
    marked = mark_any_listed(parts.withColumn("keys", url_keys(F.col("host"), F.col("path"))), "keys", "listed", listed, "host")
    host, path = F.col("host"), F.col("path")
    return marked.select(
        F.col("page_id").alias(id_col), "host", "path", longest_rule(host, path, rules, "name").alias("rule"),
        F.coalesce(longest_rule(host, path, rules, "verdict"),
                   F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
