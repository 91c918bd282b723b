"""Quality rules: the log-likelihood ratio of hashed word n-grams between a
trusted target and the raw corpus.

Words and adjacent word pairs are hashed into ``BUCKETS``.  The raw
multinomial counts every document, the target one the trusted labelled
documents (quality 1, not toxic; a hash-chosen ``TARGET_ROWS`` of them at
most, so that their ids can be sent to every task).  A document's score is the
mean over its n-grams of log p_target / p_raw.  The threshold is the score
that separates all labelled documents best, read from a histogram of scores;
every document is then judged by the same comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstream.llm.common import unit_hash

BUCKETS = 1 << 15
#: Expected number of trusted documents that make the target multinomial.
TARGET_ROWS = 20_000
#: Scores are compared in steps of 1 / STEPS, between -SPAN and SPAN.
STEPS, SPAN = 1000, 12
SMOOTH = 1.0
#: Share of the trusted documents that the threshold has to keep.
KEEP_TRUSTED = 0.9995

# White space and symbol characters of the base counts.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
_ID_BITS = 21


class Words(dict):
    """Word -> number; ``hashes`` holds each number's 64-bit hash, in room that
    doubles as words come."""

    LIMIT = 1 << 20

    def __init__(self):
        super().__init__()
        self._fresh: list[int] = []
        self.hashes = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self._fresh.append(xxhash.xxh64_intdigest(word))
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
            self.hashes = np.zeros(0, np.uint64)
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self._fresh:
            if len(self) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(max(len(self), 1 << 12), np.uint64)])
            self.hashes[len(self) - len(self._fresh):len(self)] = self._fresh
            self._fresh = []
        return out


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(ids) < 4:
        return 0
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if ids.max() >> _ID_BITS:
        _, inverse, n = np.unique(np.stack([a, b, c], 1), axis=0, return_inverse=True, return_counts=True)
    else:
        _, inverse, n = np.unique((a << (2 * _ID_BITS)) | (b << _ID_BITS) | c, return_inverse=True, return_counts=True)
    again = np.concatenate([[False, False], n[inverse.ravel()] > 1, [False, False]])
    return int((again[2:] | again[1:-1] | again[:-2]).sum())


def n_gram_buckets(words: Words, ids: np.ndarray) -> np.ndarray:
    h = words.hashes[ids]
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pairs ^= pairs >> np.uint64(29)
    pairs *= np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([h, pairs]) >> np.uint64(49)).astype(np.int64)


def base_counts(text: str, words: Words) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    data = text.encode("utf-8", "surrogatepass")
    found = data.split()
    ids = words.numbers(found)
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(found), chars, symbols, len(lines) - len(set(lines)), repeated_words(ids)), ids


def _counts(trusted) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), trusted.value
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    n = np.bincount(n_gram_buckets(words, words.numbers(text.encode("utf-8", "surrogatepass").split())),
                                    minlength=BUCKETS)
                    raw += n
                    if doc in known:
                        target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])
    return run


def log_ratios(df: DataFrame, trusted: set, id_col: str, text_col: str) -> np.ndarray:
    """log p_target / p_raw of each bucket, smoothed by the raw distribution."""
    shared = df.sparkSession.sparkContext.broadcast(trusted)
    rows = df.select(id_col, text_col).mapInArrow(_counts(shared), "bucket bigint, raw bigint, target bigint") \
             .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not raw.sum() or not target.sum():
        return np.zeros(BUCKETS)
    p_raw = (raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    p_target = (target + SMOOTH * BUCKETS * p_raw) / (target.sum() + SMOOTH * BUCKETS)
    return np.log(p_target / p_raw)


def _scored(shared):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ratio = Words(), shared.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                counts, ids = base_counts(text or "", words)
                score = float(ratio[n_gram_buckets(words, ids)].mean()) if len(ids) else 0.0
                out.append((*counts, round(score, 9)))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.float64())], names)
    return run


def trusted_labels(labels: DataFrame) -> DataFrame:
    """(id, good): one row per labelled id; good if every label of it says so."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce((F.min("quality") >= 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0), F.lit(False)).alias("good"))


def threshold(histogram: list[tuple[int, int, int]], keep: float = KEEP_TRUSTED) -> float:
    """(step, good, bad) -> the score from which documents stay: of those that
    keep the share ``keep`` of the good ones, the one that drops most bad ones;
    the lowest such score.  Without labels of both kinds nothing goes."""
    good, bad = sum(g for _, g, _ in histogram), sum(b for *_, b in histogram)
    if not good or not bad:
        return float("-inf")
    best, lost, dropped, most = float("-inf"), 0, 0, 0
    for step, g, b in sorted(histogram):
        lost, dropped = lost + g, dropped + b
        if lost > (1 - keep) * good:
            break
        if dropped > most:
            best, most = (step + 1) / STEPS, dropped
    return best


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score), a row per row.

    A null text is empty: no words, score 0, and so failed by the base rule.
    Equal texts score alike.  Without usable labels every document that
    passes the base rules stays.  Other columns are not read.
    """
    spark = df.sparkSession
    lab = trusted_labels(labels).checkpoint()
    good = lab.where("good")
    n = max(good.count(), 1)
    ids = {r["id"] for r in good.where(unit_hash(F.lit("target"), F.col("id").cast("string")) < TARGET_ROWS / n).collect()}
    ratio = spark.sparkContext.broadcast(log_ratios(df, ids, id_col, text_col).round(9))
    kind = df.schema[id_col].dataType.simpleString()
    scored = df.select(id_col, text_col).mapInArrow(
        _scored(ratio), f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                        "n_repeat_words bigint, score double").checkpoint()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    step = F.floor(F.greatest(F.least("score", F.lit(SPAN)), F.lit(-SPAN)) * STEPS)
    histogram = (scored.where(~failed).join(lab, F.col("doc_id") == F.col("id")).groupBy(step.alias("step"))
                 .agg(F.sum(F.col("good").cast("bigint")).alias("g"), F.sum((~F.col("good")).cast("bigint")).alias("b"))
                 .collect())  # 2 * SPAN * STEPS + 1 rows at most
    least = threshold([(r["step"], r["g"], r["b"]) for r in histogram])
    return scored.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= F.lit(least))).alias("kept"), "score")
