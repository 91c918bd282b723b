"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents.  A document's signature is a Bloom filter
of its (term, level) pairs, where level l stands for "occurs ``LEVELS[l]``
times or more"; a block stores the signatures as bit slices, one row bitmap for
each bit, so the bitmap of the documents that may hold a pair is the AND of a
few slices.  Documents of a block have about as many pairs each, and its
slices are as many as these need.

A query looks up its terms' bitmaps level by level.  Bitmaps overestimate, so
the sums of the terms' weights over them, times what a level can add to a
score, bound each document's score from above.  A search then

1. scores exactly the k documents of the highest bounds for each item, which
   gives a score that the k-th best reaches at least;
2. scores exactly every document whose bound is not below that.

No document is left out without that proof, so the result is that of scoring
all.  The work runs on index blocks and documents where they lie; a group of
items (``GROUP_BYTES`` of text) meets all blocks at once, and more items are
more groups.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkstream.llm.common import written

#: Least occurrences of each level; a level's documents hold a term at most one less than the next one's.
LEVELS = (1, 2, 3, 4, 6, 9, 16)
#: Slices of a pair, and bits of a signature for each of its pairs.
SLICES, BITS_PER_PAIR = 4, 12
#: Documents of a block, bytes of its slices, and bits of a signature, at most (a fuller one only bounds less tightly).
BLOCK_ROWS, BLOCK_BYTES, MAX_BITS = 1024, 2 << 20, 1 << 22
#: Bytes of text that a task indexes at once (one text, if it is longer).
BUFFER_BYTES = 8 << 20
#: Bytes of items' texts that are searched at once; items and terms of a matrix product.
GROUP_BYTES, GROUP_ITEMS, GROUP_TERMS = 512 << 10, 64, 4096
#: Candidate pairs up to this many are broadcast to the documents; beyond it they are joined.
BROADCAST_PAIRS = 500_000
#: Terms whose hashes a task remembers.
CACHED_TERMS = 500_000

# A term is a run of these bytes (non-ASCII ones included), A-Z lower-cased.
_TERM_BYTES = frozenset([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TABLE = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in _TERM_BYTES else 0x20 for b in range(256))
# The score's constants.
W_SCALE, GAIN_SCALE, TF_SCALE, M_SCALE, M_BASE, M_SLOPE = 1000, 1_000_000_000, 1000, 20, 50, 50


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(W_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n, n_docs: int, n_terms: int):
    return M_BASE + (M_SLOPE * n * n_docs) // n_terms


def gain(tf, m):
    return (GAIN_SCALE * tf) // (TF_SCALE * tf + M_SCALE * m)


class _Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        if len(self) >= CACHED_TERMS:
            self.clear()
        self[term] = h = xxhash.xxh64_intdigest(term)
        return h


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(hashes: np.ndarray, level: int) -> np.ndarray:
    """(pairs, SLICES) hash values of (term, level) pairs; a block takes them modulo its bits."""
    seeds = np.arange(1, SLICES + 1, dtype=np.uint64) + np.uint64(SLICES * level)
    return _mix(hashes[:, None] + seeds * np.uint64(0x9E3779B97F4A7C15))


# ---- index ----

_INDEX = "bits int, slices binary, ids array<{kind}>, keys array<bigint>, n array<bigint>, docs bigint, terms bigint"


def _blocks(ids: pa.Array, keys: pa.Array, texts: list) -> Iterator[tuple]:
    hashes, counts, sizes, n = [], [], [], []
    for text in texts:
        found = Counter(terms(text)) if text else {}
        hashes.append(np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found)))
        counts.append(tf := np.fromiter(found.values(), np.int64, len(found)))
        n.append(int(tf.sum()))
        sizes.append(int(sum((tf >= least).sum() for least in LEVELS)))
    n, sizes = np.array(n, np.int64), np.array(sizes, np.int64)
    order = [i for i in np.argsort(sizes, kind="stable")[::-1] if n[i]]
    at = 0
    while at < len(order):
        bits = min(MAX_BITS, -(-BITS_PER_PAIR * int(sizes[order[at]]) // 64) * 64)
        rows = order[at:at + max(8, min(BLOCK_ROWS, BLOCK_BYTES * 8 // bits // 8 * 8))]
        at += len(rows)
        width = -(-len(rows) // 8) * 8
        matrix = np.zeros((bits, width), bool)
        h, tf = np.concatenate([hashes[i] for i in rows]), np.concatenate([counts[i] for i in rows])
        row = np.repeat(np.arange(len(rows)), [len(hashes[i]) for i in rows])
        for level, least in enumerate(LEVELS):
            keep = tf >= least
            h, tf, row = h[keep], tf[keep], row[keep]
            if not len(h):
                break
            matrix[(_slots(h, level) % np.uint64(bits)).astype(np.int64), row[:, None]] = True
        take = pa.array(rows)
        yield bits, np.packbits(matrix, axis=1).tobytes(), ids.take(take), keys.take(take), n[rows], len(rows), int(n[rows].sum())


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks over all texts with a term, as a table of the shared folder."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BUFFER_BYTES, side="right")))
                piece = batch.slice(at, to - at)
                at = to
                for bits, slices, ids, keys, n, docs, total in _blocks(piece.column(0), piece.column(1), piece.column(2).to_pylist()):
                    lists = [pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), x) for x in (ids, keys, pa.array(n))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bits], pa.int32()), pa.array([slices], pa.binary()), *lists, pa.array([docs]), pa.array([total])],
                        ["bits", "slices", "ids", "keys", "n", "docs", "terms"])

    rows = df.select(F.col(id_col).alias("id"), _key(text_col).alias("key"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, _INDEX.format(kind=kind)))


def _key(text_col: str):
    return F.xxhash64(F.col(text_col))


# ---- queries ----

class Items:
    """A group of items: their terms that a document holds, with weights."""

    def __init__(self, texts: list[list[bytes]], df: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        known = sorted(t for t, n in df.items() if n and weight(n_docs, n))
        self.term = {t: i for i, t in enumerate(known)}
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in known], np.uint64)
        self.weights = np.array([weight(n_docs, df[t]) for t in known], np.int64)
        self.of = [np.array(sorted({self.term[t] for t in text if t in self.term}), np.int64) for text in texts]
        self.least = np.ones(len(texts), np.int64)  # scores below these are of no use
        self._parts = None

    def __getstate__(self):
        return self.__dict__ | {"_parts": None}

    def parts(self) -> list[tuple[list[int], np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(items, terms, weights (items, terms), hash values by level): matrices of bounded size."""
        if self._parts is None:
            self._parts = []
            held: list[int] = []
            size = 0
            for i, of in [*enumerate(self.of), (None, ())]:
                if held and (i is None or len(held) == GROUP_ITEMS or size + len(of) > GROUP_TERMS):
                    every = np.unique(np.concatenate([self.of[x] for x in held]))
                    for at in range(0, len(every), GROUP_TERMS):
                        some = every[at:at + GROUP_TERMS]
                        w = np.zeros((len(held), len(some)), np.float32)
                        for r, x in enumerate(held):
                            mine = self.of[x][np.isin(self.of[x], some)]
                            w[r, np.searchsorted(some, mine)] = self.weights[mine]
                        self._parts.append((held, some, w, [_slots(self.hashes[some], v) for v in range(len(LEVELS))]))
                    held, size = [], 0
                if i is not None and len(of):
                    held.append(i)
                    size += len(of)
        return self._parts

    def bounds(self, bits: int, slices: bytes, n: np.ndarray) -> np.ndarray:
        """(items, documents of the block): no score is above its bound."""
        width = -(-len(n) // 8)
        matrix = np.frombuffer(slices, np.uint8).reshape(bits, width)
        m = length_norm(n, self.n_docs, self.n_terms)
        most = [np.minimum(upto - 1, n) for upto in LEVELS[1:]] + [n]
        gains = np.stack([gain(tf, m) for tf in most]).astype(np.float64)
        added = np.diff(gains, axis=0, prepend=0)
        out = np.zeros((len(self.of), len(n)))
        for items, some, w, slots in self.parts():
            total = np.zeros((len(items), len(n)))
            keep, maps = np.arange(len(some)), None
            for level, values in enumerate(slots):
                at = (values[keep] % np.uint64(bits)).astype(np.int64)
                found = matrix[at[:, 0]]
                for j in range(1, SLICES):
                    found &= matrix[at[:, j]]
                if maps is not None:
                    found &= maps  # who lacks a level lacks those above it
                some_doc = found.any(axis=1)
                keep, maps = keep[some_doc], found[some_doc]
                if not len(keep):
                    break
                held = np.unpackbits(maps, axis=1, count=len(n)).astype(np.float32)
                total += (w[:, keep] @ held) * added[level]
            out[items] += total
        return out

    def scores(self, found: Counter, n: int, items: np.ndarray) -> np.ndarray:
        """Exact scores of a document with these terms."""
        tf = np.zeros(len(self.weights), np.int64)
        for t, c in found.items():
            if (i := self.term.get(t)) is not None:
                tf[i] = c
        worth = self.weights * gain(tf, length_norm(n, self.n_docs, self.n_terms))
        return np.array([worth[self.of[i]].sum() for i in items], np.int64)


def _document_frequencies(docs: DataFrame, text_col: str, wanted: list[bytes]) -> dict[bytes, int]:
    """Exact counts over all documents of the terms of one group of items."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(wanted)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        n = np.zeros(len(place), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    n[[place[t] for t in place.keys() & set(terms(text))]] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term bigint, n bigint")
    return {wanted[r["term"]]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _highest(index: DataFrame, shared, k: int) -> DataFrame:
    """(item, id, key): of each item, the k documents of the highest bounds."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        held: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, keys = (batch.column(c)[i].values for c in (2, 3))
                n = batch.column(4)[i].values.to_numpy()
                bounds = items.bounds(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), n)
                for item, row in enumerate(bounds):
                    top = np.argpartition(-row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                    top = top[row[top] > 0]
                    if item in held:
                        b, d, x = held[item]
                        if len(b) == k:
                            top = top[row[top] > b[-1]]
                        if not len(top):
                            continue
                        b, d, x = np.concatenate([b, row[top]]), pa.concat_arrays([d, ids.take(pa.array(top))]), \
                            pa.concat_arrays([x, keys.take(pa.array(top))])
                    elif len(top):
                        b, d, x = row[top], ids.take(pa.array(top)), keys.take(pa.array(top))
                    else:
                        continue
                    best = np.argsort(-b, kind="stable")[:k]
                    held[item] = b[best], d.take(pa.array(best)), x.take(pa.array(best))
        for item, (b, d, x) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(b), pa.int32()), pa.array(b), d, x], ["item", "bound", "id", "key"])

    found = index.mapInArrow(run, f"item int, bound double, id {kind}, key bigint")
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "id", "key")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("item", "id", "key")


def _not_excluded(index: DataFrame, shared) -> DataFrame:
    """(item, id, key): every document whose bound reaches the item's least score."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column(4)[i].values.to_numpy()
                bounds = items.bounds(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), n)
                item, doc = np.nonzero(bounds >= items.least[:, None])
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), *(batch.column(c)[i].values.take(take) for c in (2, 3))],
                                                 ["item", "id", "key"])

    return index.mapInArrow(run, f"item int, id {kind}, key bigint")


def _scored(docs: DataFrame, id_col: str, text_col: str, candidates: DataFrame, shared) -> DataFrame:
    """(item, id, score) of every document row that stands among ``candidates``
    (item, id, key), by its whole text."""
    found = written(candidates.groupBy("id", "key").agg(F.collect_set("item").alias("items")))
    pairs = found.agg(F.coalesce(F.sum(F.size("items") + 2), F.lit(0)).alias("n")).first()["n"]
    right = found.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "items")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = rows.join(F.broadcast(right) if pairs <= BROADCAST_PAIRS else right,
                       F.col("id").eqNullSafe(F.col("_id")) & (_key("text") == F.col("_key")))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                text, mine = batch.column(1)[i].as_py(), batch.column(2)[i].values.to_numpy()
                every = terms(text)
                scores = items.scores(Counter(every), len(every), mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine), batch.column(0).take(pa.array(np.full(len(mine), i))), pa.array(scores)], ["item", "id", "score"])

    return joined.select("id", "text", "items").mapInArrow(run, f"item int, id {kind}, score bigint").where(F.col("score") > 0)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """-> (item, rank, doc, score): each item's k best documents with a score above 0.

    A null text has no terms, and an item without terms (or whose terms no
    document holds) no rows.  Every document row counts, repeated ones too;
    equal scores rank by rising id, null ids last.  Items equal in id and text
    are one item; of those equal in id only, each has its own ranking.  Empty
    tables give an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col) if index is None else index
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0)).alias("n")).first()["n"]
    total = index.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    groups = -(-size // GROUP_BYTES)
    parts = []
    for g in range(groups if total["docs"] else 0):
        of = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        rows = sorted(of.collect(), key=lambda r: (str(r["item_id"]), r["text"]))  # one group's texts
        texts = [terms(r["text"]) for r in rows]
        df = _document_frequencies(docs, text_col, sorted(set().union(*texts)))
        group = Items(texts, df, total["docs"], total["terms"])
        shared = spark.sparkContext.broadcast(group)
        tried = _scored(docs, id_col, text_col, _highest(index, shared, k), shared)
        kth = Window.partitionBy("item").orderBy(F.col("score").desc())
        reached = tried.withColumn("place", F.row_number().over(kth)).where(F.col("place") <= k) \
                       .groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        for r in reached.collect():  # a row an item
            group.least[r["item"]] = r["least"]
        shared = spark.sparkContext.broadcast(group)
        scored = _scored(docs, id_col, text_col, _not_excluded(index, shared), shared)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)],
                                      f"_item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        parts.append(best.join(names, F.col("item") == F.col("_item")).select("item_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
    if not parts:
        parts = [asked.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(docs.schema[id_col].dataType).alias("id"),
                                             F.lit(0).cast("bigint").alias("score"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
