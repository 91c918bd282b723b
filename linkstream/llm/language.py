"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, fitted by follow-the-regularised-leader with elastic-net
penalties, then calibrated by a temperature.

Letters are lower-cased and every run of other characters is one separator;
1- to 3-grams of that sequence are hashed into ``DIM`` features.  Document
frequencies are counted over all learning documents; the regression is fitted
on a bounded sample of them (``PER_LANG`` documents a language and
``SAMPLE_ROWS`` in all, chosen by a hash of the id), the temperature on the part of that sample it has not seen.
Prediction reads the text only.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstream.llm.common import free_name, unit_hash

DIM_BITS = 14
DIM = 1 << DIM_BITS
#: Expected number of sampled documents of a language (all, if it has fewer), and of all languages.
PER_LANG, SAMPLE_ROWS = 400, 40_000
CALIBRATION_SHARE = 0.25
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 0.01, 0.01
CHUNK = 1 << 20
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> lower-case code of a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            out[cp] = ord(ch.lower()[0])
    return out


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text; the letters' own count is
    zero everywhere exactly if the text has no letter."""
    table = _letters()
    counts = np.zeros(DIM, np.int64)
    carry = np.zeros(2, np.uint32)
    shift = np.uint32(32 - DIM_BITS)
    for at in range(0, len(text), CHUNK):
        code = table[np.frombuffer(text[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")]
        before = np.concatenate([carry[-1:], code[:-1]])
        code = code[(code != 0) | (before != 0)]
        if not len(code):
            continue
        seq = np.concatenate([carry, code])
        a, b, c = seq[:-2], seq[1:-1], seq[2:]
        two = b * np.uint32(0x9E3779B1) + c * np.uint32(0x85EBCA77)
        three = a * np.uint32(0xC2B2AE3D) + two
        one = c[c != 0] * np.uint32(0x27D4EB2F)
        counts += np.bincount(np.concatenate([one, two ^ (two >> np.uint32(15)), three ^ (three >> np.uint32(13))]) * np.uint32(0x165667B1) >> shift,
                              minlength=DIM)
        carry = seq[-2:]
    return counts


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return at, x / norm if norm else x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> np.ndarray:
    """Weights (classes, DIM + 1), the last column being the bias."""
    z, n = np.zeros((classes, DIM + 1)), np.zeros((classes, DIM + 1))

    def weights(at):
        zi, ni = z[:, at], n[:, at]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at = np.append(rows[i][0], DIM)
            x = np.append(rows[i][1], 1.0)
            w = weights(at)
            err = _softmax(w @ x)
            err[labels[i]] -= 1
            g = err[:, None] * x
            n_new = n[:, at] + g * g
            z[:, at] += g - (np.sqrt(n_new) - np.sqrt(n[:, at])) / ALPHA * w
            n[:, at] = n_new
    return weights(np.arange(DIM + 1))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        s = logits / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]))

    lo, hi, r = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    while hi - lo > 1e-4:
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not has_letter(text):
            return UNKNOWN, 0.0
        at, x = _features(gram_counts(text), self.idf)
        p = _softmax((self.weights[:, at] @ x + self.weights[:, -1]) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def held_out(id_col: str) -> Column:
    """Documents never learned from: crc32 of the id's text is a multiple of 5,
    or there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(DIM + 1, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            df[:-1] += gram_counts(text) > 0
            df[-1] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["feature", "n"])


def _sampled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for text in batch.column(0).to_pylist():
            c = gram_counts(text)
            nz = np.flatnonzero(c)
            at.append(nz.astype("<u2").tobytes())
            n.append(np.minimum(c[nz], 0xFFFFFFFF).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())],
                                         ["lang", "u", "at", "n"])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the texts and non-null languages of documents not held out;
    null texts teach nothing.  Without any such document the model knows no
    language."""
    learn = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
        unit_hash(F.lit("language sample"), F.col(id_col).cast("string")).alias("u"))
    sizes = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.ones(DIM), np.zeros((0, DIM + 1)), 1.0)
    per_lang = min(PER_LANG, SAMPLE_ROWS / len(langs))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_lang / n))) for k, n in sizes.items()])
    sample = learn.where(F.col("u") < share).select("text", "lang", (F.col("u") / share).alias("u")) \
                  .mapInArrow(_sampled_counts, "lang string, u double, at binary, n binary").collect()
    counted = learn.select("text").mapInArrow(_document_frequencies, "feature bigint, n bigint") \
                   .groupBy("feature").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows at most
    df_n = np.zeros(DIM + 1)
    for r in counted:
        df_n[r["feature"]] = r["n"]
    idf = np.log((1 + df_n[-1]) / (1 + df_n[:-1])) + 1

    sample.sort(key=lambda r: (r["u"], r["lang"], bytes(r["at"]), bytes(r["n"])))
    rows, labels = [], np.array([langs.index(r["lang"]) for r in sample], int)
    for r in sample:
        counts = np.zeros(DIM, np.int64)
        counts[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u4")
        rows.append(_features(counts, idf))
    cal = np.array([r["u"] >= 1 - CALIBRATION_SHARE for r in sample], bool)
    w = fit_ftrl([rows[i] for i in np.flatnonzero(~cal)], labels[~cal], len(langs))
    logits = np.array([w[:, rows[i][0]] @ rows[i][1] + w[:, -1] for i in np.flatnonzero(cal)]).reshape(-1, len(langs))
    return Model(langs, idf, w, fit_temperature(logits, labels[cal]))


def recognised(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` whose text has a letter, a null ``lang_col`` filled with the
    predicted language (if the model knows any)."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [has_letter(t or "") for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(flags, pa.bool_()))

    if not model.langs:
        return df.mapInArrow(run, df.schema)
    pred, _ = free_name(df, "lang_pred", "score")
    found = identify(df, model, text_col).where(F.col(pred) != UNKNOWN)
    return found.withColumn(lang_col, F.coalesce(lang_col, pred)).select(*df.columns)


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with lang_pred and score (0 to 1) after their columns.

    A null text and one without a letter (empty ones too) are ``und`` with
    score 0.  A new column whose name is taken gets leading underscores.
    """
    pred, score = free_name(df, "lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                [*batch.schema.names, pred, score])

    schema = T.StructType([*df.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return df.mapInArrow(run, schema)
