"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (lower case, words parted by white
space); a text of one to four words is one shingle.  Links join texts whose
sets have a Jaccard similarity of 0.8 or more.

1. Texts with the same words are one *class*; the rest works on classes.
2. A class has ``HASHES`` MinHash values.  Classes that agree on one of the
   ``BANDS`` bands share a bucket; two classes at 0.8 share none with
   probability (1 - 0.8**4)**32 = 5e-8.
3. Each bucket names its smallest member as *pivot*.  The members of all
   buckets of a pivot are one group, so every candidate pair lies in a group,
   once or a few times instead of once a band.  A pair counts in the group of
   its smallest common pivot only.
4. A group is cut into blocks of bounded size, and two blocks at a time meet in
   a task (a *cell*).  MinHash values are compared ``STEP`` at a time; a pair
   whose posterior probability of reaching the threshold (uniform prior) falls
   below ``TOLERANCE`` is dropped.  All others are verified exactly on their
   shingle sets.
5. A cell returns, per member, the number of its links, and a spanning forest
   of the links: as many rows as members, never a row per pair.
6. Components come from the forests by min-label propagation with pointer
   jumping, over narrow written tables.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstream.llm.common import free_name, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-9
#: Members and bytes of text of a block, about.
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20
CACHED_WORDS = 400_000
#: Cells on the whole matrix when more pairs than this per member are left.
DENSE_PAIRS = 8


# ---- texts to shingles and signatures -------------------------------------

def normal_form(text: Column) -> Column:
    """Words in lower case with one blank between; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+", " "))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    return h


def shingles(normal: str) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted."""
    if not normal:
        return np.zeros(0, np.uint64)
    words = normal.split(" ")
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - size + 1 + k])
    return np.unique(out)


@functools.cache
def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
    return a[:, None], rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)[:, None]


def signature(sh: np.ndarray) -> np.ndarray:
    """32-bit MinHash values; a long set goes through in pieces."""
    a, b = _hash_family()
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sh), 4096):
        h = (sh[None, at:at + 4096] * a + b) >> np.uint64(32)
        low = np.minimum(low, h.min(1).astype(np.uint32))
    return low


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bands, sig, size = [], [], []
        for text in batch.column(2).to_pylist():
            sh = shingles(text)
            s = signature(sh)
            bands.append([xxhash.xxh64_intdigest(s[ROWS * i:ROWS * (i + 1)].tobytes(), seed=i) - (1 << 63) for i in range(BANDS)]
                         if len(sh) else [])
            sig.append(s.astype("<u2").tobytes())
            size.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary()),
             pa.array(size, pa.int64())], ["doc_id", "k", "bands", "sig", "size"])


# ---- pruning and verification in a cell ------------------------------------

@functools.cache
def least_matches() -> tuple[tuple[int, int], ...]:
    """(hashes seen, matches needed): below it the posterior probability that
    the similarity is THRESHOLD or more is under TOLERANCE.

    With a uniform prior and m of n equal, the posterior is Beta(m + 1,
    n - m + 1), whose upper tail at t is P(Bin(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * THRESHOLD ** m * (1 - THRESHOLD) ** (n + 1 - m)
            if tail >= TOLERANCE:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def _candidates(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that the posterior does not rule out."""
    steps = least_matches()
    left, right = [], []
    for at in range(0, len(a), 64):
        piece = a[at:at + 64]
        n, need = steps[0]
        equal = (piece[:, None, :n] == b[None, :, :n]).sum(2)
        i, j = np.nonzero(equal >= need)
        if same:
            i, j = (x[i + at < j] for x in (i, j))
        m = equal[i, j]
        for (n0, _), (n, need) in zip(steps, steps[1:]):
            if not len(i):
                break
            m = m + (piece[i, n0:n] == b[j, n0:n]).sum(1)
            keep = m >= need
            i, j, m = i[keep], j[keep], m[keep]
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # J >= 4 / 5 in whole numbers
    return 5 * shared >= 4 * (a + b - shared)


def _verify(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs reach the threshold exactly."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(i) <= DENSE_PAIRS * len(sets):
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    else:
        rows = np.repeat(np.arange(len(sets)), size)
        values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = np.flatnonzero(times > 1)
        column = np.full(len(values), -1)
        column[common] = np.arange(len(common))
        at = column[place]
        rows, at = rows[at >= 0], at[at >= 0]
        dots = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2**24 are exact
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        for lo in range(0, len(common), 4096):
            a, b = np.searchsorted(at, [lo, lo + 4096])
            m = np.zeros((len(sets), min(4096, len(common) - lo)), np.float32)
            m[rows[a:b], at[a:b] - lo] = 1
            dots += m @ m.T
        shared = dots[i, j].astype(np.int64)
    return _similar(shared, size[i], size[j])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """(member, root) of each member that is not its component's root."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in range(n) if root(x) != x]


def cell_links(pivot: int, members: list[dict], same: bool) -> list[tuple[int, int, int, int]]:
    """(node, partner texts, partner documents, a node of its tree or itself)."""
    a = [m for m in members if m["side"] == 0]
    b = a if same else [m for m in members if m["side"] == 1]
    if not a or not b or len(a) + len(b) < 2:  # a block may have got no member
        return []
    everyone = a if same else a + b
    shift = 0 if same else len(a)
    sig = [np.frombuffer(b"".join(m["sig"] for m in x), "<u2").reshape(len(x), HASHES) for x in (a, b)]
    i, j = _candidates(sig[0], sig[1], same)
    j = j + shift
    if len(i):  # a pair belongs to its smallest common pivot
        smaller: dict[int, list[int]] = {}
        for x, m in enumerate(everyone):
            for p in m["pivots"]:
                if p < pivot:
                    smaller.setdefault(p, []).append(x)
        fresh = np.ones(len(i), bool)
        for who in smaller.values():
            if len(who) > 1:
                has = np.zeros(len(everyone), bool)
                has[who] = True
                fresh &= ~(has[i] & has[j])
        i, j = i[fresh], j[fresh]
    if not len(i):
        return []
    used = np.unique(np.concatenate([i, j]))
    place = np.zeros(len(everyone), np.int64)
    place[used] = np.arange(len(used))
    ok = _verify([shingles(everyone[x]["text"]) for x in used], place[i], place[j])
    i, j = i[ok], j[ok]
    docs = np.array([m["n"] for m in everyone], np.int64)
    texts, copies = np.zeros(len(everyone), np.int64), np.zeros(len(everyone), np.int64)
    for x, y in ((i, j), (j, i)):
        np.add.at(texts, x, 1)
        np.add.at(copies, x, docs[y])
    tree = dict(_forest(len(everyone), i, j))
    node = [m["node"] for m in everyone]
    return [(node[x], int(texts[x]), int(copies[x]), node[tree.get(x, x)]) for x in np.flatnonzero(texts)]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by cell; one cell is held at a time."""
    key, members = None, {}

    def done():
        # a class may arrive in several equal rows
        return cell_links(key[0], list(members.values()), key[1] == key[2]) if key else []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], ["node", "texts", "docs", "other"])

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (at := (row["pivot"], row["b1"], row["b2"])) != key:
                out += done()
                key, members = at, {}
            members[row["side"], row["node"]] = row
        if out:
            yield batch_of(out)
    if rows := done():
        yield batch_of(rows)


# ---- the join ---------------------------------------------------------------

def classes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, k), classes (node, k, rep, n, bands, sig, size)), checkpointed."""
    normal = normal_form(F.col(text_col))
    signed = df.select(F.col(id_col).alias("doc_id"), normal.alias("t")) \
               .select("doc_id", F.unhex(F.md5("t")).alias("k"), "t")
    kind = signed.schema["doc_id"].dataType.simpleString()
    rows = signed.mapInArrow(_signed, f"doc_id {kind}, k binary, bands array<bigint>, sig binary, size bigint").checkpoint()
    found = rows.groupBy("k").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"),
                                  F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("size").alias("size")).checkpoint()
    # The checkpoint fixes the partitions, so the numbers are fixed too.
    return rows.select("doc_id", "k"), found.withColumn("node", F.monotonically_increasing_id())


def candidate_groups(found: DataFrame) -> DataFrame:
    """(pivot, node): the groups that hold every candidate pair."""
    at = found.select("node", F.explode("bands").alias("bucket"))
    pivots = at.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("m")) \
               .where(F.col("m") > 1).select(F.col("bucket").alias("b"), "pivot")
    return at.join(pivots, F.col("bucket") == F.col("b")).select("pivot", "node").distinct()


def class_links(df: DataFrame, text_col: str, found: DataFrame) -> DataFrame:
    """(node, texts, docs, other) rows of all cells, checkpointed."""
    groups = candidate_groups(found.select("node", "bands")).checkpoint()
    pivots = groups.groupBy("node").agg(F.sort_array(F.collect_list("pivot")).alias("pivots"))  # BANDS at most
    normal = normal_form(F.col(text_col))
    wanted = found.select("node", "k", "n", "sig").join(pivots, "node")
    texts = df.select(normal.alias("text")).withColumn("kt", F.unhex(F.md5("text"))) \
              .groupBy("kt").agg(F.first("text").alias("text"))
    full = texts.join(wanted, F.col("kt") == F.col("k")).select("node", "n", "sig", "pivots", "text")
    # A block is about BLOCK_ROWS members or BLOCK_BYTES of text, whichever is less.  Only groups of several
    # blocks take part in the join by pivot, whose large side Spark can split: the other one is a table.
    blocks = found.select("node", "size").join(groups, "node").groupBy(F.col("pivot").alias("p")).agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("size") / BLOCK_BYTES, F.lit(1))).cast("int").alias("nb"))
    blocks = written(blocks.where("nb > 1"))
    one = full.withColumn("pivot", F.explode("pivots"))
    sized = one.join(blocks, F.col("pivot") == F.col("p"), "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    met = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = met.select("pivot", F.least("b", "other").alias("b1"), F.greatest("b", "other").alias("b2"),
                       F.when(F.col("b") <= F.col("other"), 0).otherwise(1).alias("side"),
                       "node", "n", "sig", "pivots", "text")
    ordered = cells.repartition(F.col("pivot"), F.col("b1"), F.col("b2")).sortWithinPartitions("pivot", "b1", "b2")
    return ordered.mapInArrow(_cells, "node bigint, texts bigint, docs bigint, other bigint").checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): the least node of its
    component.  Each round hooks every root onto the least root next to it and
    then halves the paths, so rounds grow with the logarithm of a chain."""
    real = edges.where("a <> b").select("a", "b")
    both = written(real.union(real.select("b", "a")).distinct())
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        # the least label among neighbours, carried to the root
        near = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b") \
                   .join(label.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        hook = written(near.where(F.col("rb") < F.col("ra")).groupBy("ra").agg(F.min("rb").alias("to")))
        if hook.isEmpty():
            return label
        # follow hooks of hooks: roots only ever point to smaller ones
        for _ in range(2):
            hook = hook.join(hook.select(F.col("ra").alias("to"), F.col("to").alias("next")), "to", "left") \
                       .select("ra", F.coalesce("next", "to").alias("to"))
        label = written(label.join(hook.withColumnRenamed("ra", "root"), "root", "left")
                             .select("node", F.coalesce("to", "root").alias("root")))


def clustered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, k), classes (k, rep, class_id, copies, texts, docs, root))."""
    rows, found = classes(df, id_col, text_col)
    links = class_links(df, text_col, found)
    degree = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    root = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    per = found.select("node", "k", "rep", "n").join(degree, "node", "left").join(root, "node", "left") \
               .withColumn("root", F.coalesce("root", "node"))
    least = per.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("class_id"),
                                                      F.min(F.struct(F.col("rep").isNull(), "rep", "k")).alias("first"))
    return rows, per.join(least, F.col("root") == F.col("r")).select(
        "k", "rep", "class_id", F.col("n").alias("copies"), F.coalesce("texts", F.lit(0)).alias("texts"),
        F.coalesce("docs", F.lit(0)).alias("docs"), (F.col("first")["k"] == F.col("k")).alias("keeper"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, class_id, copy_id, n_links, n_text_links), a row per row.

    ``class_id`` is the least id of the connected group, ``copy_id`` that of
    the rows with the same words; ``n_links`` counts the other rows whose
    similarity is 0.8 or more (equal ones too), ``n_text_links`` the different
    texts among them.  A null text is empty; texts without words are equal to
    each other and to nothing else.  Rows without id count, but a class of
    them alone has a null class_id.  Other columns are not read.
    """
    rows, per = clustered(df, id_col, text_col)
    p = per.withColumnRenamed("k", "pk")
    return rows.join(p, F.col("k") == F.col("pk")).select(
        F.col("doc_id").alias(id_col), "class_id", F.col("rep").alias("copy_id"),
        (F.col("docs") + F.col("copies") - 1).cast("bigint").alias("n_links"),
        F.col("texts").cast("bigint").alias("n_text_links"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each connected group: that of the least id, with all columns of ``df``."""
    _, per = clustered(df, id_col, text_col)
    keepers = per.where("keeper").select(F.col("k").alias("_keep"))
    key, = free_name(df, "_key")
    row = F.struct(*[F.col(c) for c in df.columns])
    # least id first, then a fixed order among rows with the same words
    rank = F.struct(F.col(id_col).isNull(), F.col(id_col), F.md5(F.to_json(row)))
    one = df.withColumn(key, F.unhex(F.md5(normal_form(F.col(text_col))))).groupBy(key).agg(F.min_by(row, rank).alias("row"))
    return one.join(keepers, F.col(key) == F.col("_keep")).select("row.*")
