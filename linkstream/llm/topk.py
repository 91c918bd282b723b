"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Every vector becomes integers, and each dimension a posting list ordered by
falling quantised impact ``|x| >> LEVEL_BITS``: segments of equal impact.  For
some queries together, segments of all dimensions are taken in rounds of falling
impact (the largest ``|q| * |x|`` among the queries) and added to the
accumulators of each.  What is not yet read can move a query's scores by no more
than ``R``, the sum over dimensions of ``|q|`` times the largest unread ``|x|``;
a vector can still be in its answer only if the accumulator is within ``2 R`` of
the k-th best.  A query is done when so few can be members that scoring them
exactly is cheaper; those that can be are scored exactly.  Nothing is estimated:
the bound is a proof.

The vectors are indexed in blocks of bounded size.  A block is dealt to a task
once, in front of the query blocks that it meets (a task for each ``SLICE`` of
them), and its index is built there once.  Each meeting returns its own k best,
and the k best of those are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL_BITS = 3
#: Vectors of one index block and queries of one query block.
INDEX_BLOCK = 16_384
QUERY_BLOCK = 1_024
#: Query blocks that meet an index block in one task, and queries that read its postings together.
SLICE, TOGETHER = 16, 128
#: Exact scoring takes over when at most this share of a block can be members.
RESCORE_SHARE = 0.02


class ImpactIndex:
    """Posting lists of one block: ids ascending, rows ``x`` (int64)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        impact = np.abs(self.x)
        level = impact >> LEVEL_BITS
        self.lists = []
        for d in range(x.shape[1]):
            rows = np.argsort(-level[:, d], kind="stable")
            levels = level[rows, d]
            starts = np.flatnonzero(np.r_[True, levels[1:] != levels[:-1]]) if len(rows) else np.zeros(0, int)
            bounds = np.r_[starts, len(rows)]
            top = ((levels[starts] + 1) << LEVEL_BITS) - 1  # no |x| of the segment is above
            self.lists.append((rows, self.x[rows, d], bounds, top))

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query, ids and scores of the k best rows whose id is not its own."""
        out = []
        for at in range(0, len(queries), TOGETHER):
            out += self._search(queries[at:at + TOGETHER], k, own[at:at + TOGETHER])
        return out

    def _search(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        n, dims = self.x.shape
        weight = np.abs(queries)
        # sums of whole numbers: exact in 32-bit floats up to 2^24
        largest = int((weight * np.array([int(li[3][0]) for li in self.lists])).sum(1).max(initial=0)) if dims else 0
        kind = np.float32 if largest < 1 << 24 else np.float64
        out: list = [None] * len(queries)
        left = np.arange(len(queries))
        alive = self.ids[:, None] != own[None, :]
        wants = np.minimum(k, alive.sum(0))
        acc = np.where(alive, 0, -np.inf).astype(kind)
        read = [0] * dims
        tau = max((int(w) * int(li[3][0]) for w, li in zip(weight.max(0), self.lists) if w), default=0)
        while len(left):
            heaviest = weight[left].max(0)
            due_dims, unread = [], np.zeros(dims, np.int64)
            piece = np.zeros((n, dims), kind)
            for d in np.flatnonzero(heaviest):
                post, value, bounds, top = self.lists[d]
                due = read[d] + int(np.searchsorted(-(heaviest[d] * top[read[d]:]), -tau, side="right"))
                if due > read[d]:
                    a, b = bounds[read[d]], bounds[due]
                    piece[post[a:b], len(due_dims)] = value[a:b]
                    due_dims.append(d)
                    read[d] = due
                if due < len(top):
                    unread[d] = top[due]
            if due_dims:
                acc += piece[:, :len(due_dims)] @ queries[left][:, due_dims].T.astype(kind)
            rest = weight[left] @ unread
            ranked = np.ascontiguousarray(acc.T)
            going = []
            for j, q in enumerate(left):
                want = wants[q]
                if not want:
                    out[q] = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    continue
                kth = np.partition(ranked[j], n - want)[n - want]
                maybe = np.flatnonzero(ranked[j] >= kth - 2 * rest[j])
                if rest[j] and len(maybe) > max(want, RESCORE_SHARE * n):
                    going.append(j)
                    continue
                maybe = maybe[alive[maybe, q]]
                score = self.x[maybe] @ queries[q]
                best = np.lexsort((self.ids[maybe], -score))[:want]
                out[q] = self.ids[maybe][best], score[best]
            left, acc = left[going], acc[:, going]
            tau //= 2
        return out


def _pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per block and dimension: ids and components as bytes."""
    x = np.array(pdf["v"].tolist(), dtype="<i8").reshape(len(pdf), -1)
    return pd.DataFrame({"block": [key[0]], "dim": [key[1]],
                         "ids": [pdf["id"].to_numpy("<i8").tobytes()], "x": [x.tobytes()]})


def _unpack(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(x, "<i8").reshape(len(i), -1)


def _search_cells(k: int):
    """Rows (block, dim, slice, is_query, ids, x) with an index block in front of
    the query blocks that it meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            for is_query, ids, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, x = _unpack(ids, x)
                if not is_query:
                    index = ImpactIndex(ids, x)
                    continue
                found = [(np.full(len(a), own), a, b) for own, (a, b) in zip(ids, index.search(x, k, ids))]
                a, b, c = (np.concatenate(y) for y in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())],
                                                 ["query_id", "vec_id", "score"])
    return run


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, dim, v): components floor(scale * x), x as double; vectors that are
    null, empty or hold a null, NaN or infinite component take no part, nor do
    rows without id; a repeated (id, vector) row counts once."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (df.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
              .select(F.col(id_col).cast("bigint").alias("id"), F.size(x).alias("dim"),
                      F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))
              .dropDuplicates(["id", "v"]))


def top_k(df: DataFrame, id_col: str, vec_col: str, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """-> (query_id, rank, vec_id, score): each query's k best other rows.

    Ties go to the smaller vec_id; a query with fewer candidates gets them
    all.  Vectors of another length than the query's have no inner product
    with it and are no candidates.  ``is_query`` is a condition on column id.
    """
    v = integer_vectors(df, id_col, vec_col, scale).checkpoint()
    n, nq = v.count(), v.where(is_query).count()
    blocks, q_blocks = max(1, -(-n // INDEX_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    packed = "block int, dim int, ids binary, x binary"

    def block(parts: int) -> Column:
        return F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias("block")

    def pack(rows: DataFrame, parts: int) -> DataFrame:
        return rows.select("*", block(parts)).groupBy("block", "dim").applyInPandas(_pack_group, packed)

    slices = -(-q_blocks // SLICE)
    # The stated queries against all rows, in blocks: each query block goes to every index block of its length,
    # and an index block once to each slice of the query blocks.
    queries = pack(v.where(is_query), q_blocks).withColumn("slice", F.floor(F.col("block") / SLICE).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("is_query", F.lit(True))
    index = pack(v, blocks).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("is_query", F.lit(False))
    asked, there = v.where(is_query).select("dim").distinct(), v.select(block(blocks), "dim").distinct()
    cells = (index.join(asked, "dim", "left_semi").unionByName(queries.join(there, ["block", "dim"], "left_semi"))
                  .repartition(blocks * slices, "block", "dim", "slice").sortWithinPartitions("block", "dim", "slice", "is_query"))
    found = cells.select("is_query", "ids", "x").mapInArrow(_search_cells(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))
