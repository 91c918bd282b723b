"""Toxicity scores by weak supervision.

1. *Voters.*  A voter fires on a text or not.  Fixed word lists and patterns
   are some; the others come from a lexicon mined from the labelled learning
   rows: words whose documents are labelled toxic far more often than usual,
   dealt over ``MINED_VOTERS`` lists.  Near copies are no evidence of their own,
   so documents are counted by groups (of equal rare words).  The labels themselves are one more
   voter, which is silent on most rows and wrong on some.
2. *Label model.*  A generative model of all votes given the hidden class.
   Expectation maximisation finds how often each voter fires in either class;
   voters that depend on each other within a class are found by conditional
   mutual information, and each then hangs on its closest one in a tree, so
   that repeated evidence counts once.  It runs over the distinct vote
   patterns of all learning documents: a round is a Spark job that returns the
   expected counts of all pairs of voters, whatever the number of documents.
   Labels are those of a bounded sample of the labelled documents
   (``LABELLED_ROWS``), which is small enough to go to every task.
3. *Classifier.*  Logistic regression over hashed words and word beginnings,
   fitted by follow-the-regularised-leader to the posteriors of a bounded,
   weighted sample (``SAMPLE_ROWS`` documents a side), then calibrated on the
   part of it that it has not seen.  Scores read the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstream.llm.common import free_name, unit_hash, written

# Insults by kind, in the languages of the corpus.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons moronic stupid dumb fool imbecile brainless",
    "worth": "loser losers worthless pathetic useless failure nobody",
    "disgust": "disgusting scum trash filth filthy garbage vermin vile",
    "mockery": "clown clowns freak freaks weirdo creep ugly liar coward",
    "coarse": "bastard bitch asshole bullshit damn crap fuck fucking shit",
    "spanish": "idiota imbécil estúpido estúpida basura asqueroso inútil payaso perdedor patético",
    "french": "imbécile stupide ordure crétin connard minable pathétique dégoûtant nul",
    "german": "dumm dummkopf abschaum versager arschloch erbärmlich widerlich wertlos trottel",
}
_INSULT = "|".join(sorted({w for k in ("mind", "worth", "disgust", "mockery", "coarse") for w in LEXICONS[k].split()}))
# Pattern voters on the lower-cased text, each with a substring without which it can't fire.
PATTERNS = {
    "addressed": ("you", rf"\byou(?:'re| are)?\s+(?:an?\s+|such\s+an?\s+|so\s+)?(?:\w+\s+)?(?:{_INSULT})\b"),
    "threat": ("you", r"\b(?:kill|hurt|beat|destroy|hunt)\s+you\b|\byou(?:'ll| will)\s+(?:die|pay|regret)\b"),
    "contempt": (" ", r"\bshut\s+up\b|\bget\s+lost\b|\bgo\s+to\s+hell\b|\bhate\s+you\b"),
    "masked": ("*", r"\b[a-z]+\*{2,}[a-z]*\b|\b[a-z]\*+[a-z]+\b"),
    "shouting": ("!!", r"!{2,}"),
}
_PATTERNS = [(need, re.compile(p)) for need, p in PATTERNS.values()]
FIXED = [*LEXICONS, *PATTERNS, "insults twice"]
#: Voters that the mined lexicon is dealt over; a vote pattern is one long.
MINED_VOTERS = 32
VOTERS = len(FIXED) + MINED_VOTERS
#: Expected number of labelled documents whose label is used (all, if there are fewer).
LABELLED_ROWS = 100_000
#: Words of the mined lexicon; the documents one needs, and by how much its rate has to beat the usual one.
LEXICON_WORDS, LEAST_DOCS, LEAST_LIFT, Z = 512, 5, 3.0, 2.58
#: Words that are counted by groups of copies, at most: those of the strongest evidence by documents.
COUNTED_WORDS = 50_000
#: A group is the GROUP_WORDS words of least hash among those of GROUP_BYTES or more (all words, if there are fewer).
GROUP_WORDS, GROUP_BYTES = 4, 9
#: Rounds of expectation maximisation without and with the tree; least dependence of its edges (nats).
ROUNDS, TREE_ROUNDS, LEAST_DEPENDENCE = 8, 6, 2e-4
#: Expected documents on either side of the classifier's sample, and their words in all, at most.
SAMPLE_ROWS, SAMPLE_WORDS = 8_000, 2_000_000
CALIBRATION_SHARE = 0.2
DIM_BITS, BEGINNINGS = 18, (5, 8)
DIM = 1 << DIM_BITS
EPOCHS, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 2.0, 1.0
#: Bounds of the calibrated logit's slope (of two classes far apart it has no best value).
SLOPES = (0.2, 5.0)
THRESHOLD = 0.7
CACHED_WORDS, HELD_WORDS = 100_000, 200_000
#: Texts that a task has as Python objects at once.
SLICE_ROWS = 512
_UNIT = 1 << 16  # expected counts are summed in whole units, so any order gives the same sum

_LETTERS = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                 for b in range(256))
_MARKS = re.compile("[\u0080-©«-´¶-¹»-¿ -⁯　-〿]+")


def words(text: str) -> set[bytes]:
    """The distinct lower-case words of a whole text."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    return set(text.encode("utf-8", "surrogatepass").translate(_LETTERS).split())


_LEXICONS = [frozenset(w.encode() for w in v.split()) for v in LEXICONS.values()]
_INSULTS = frozenset().union(*_LEXICONS)


def fixed_votes(text: str, bag: set[bytes]) -> int:
    """Bit i is the vote of FIXED[i]."""
    votes = sum(1 << i for i, lexicon in enumerate(_LEXICONS) if not lexicon.isdisjoint(bag))
    low = text.lower()
    votes |= sum(1 << (len(_LEXICONS) + i) for i, (need, p) in enumerate(_PATTERNS) if need in low and p.search(low))
    return votes | (int(len(bag & _INSULTS) > 1) << (len(FIXED) - 1))


def held_out(id_col: str) -> Column:
    """Documents never learned from: crc32 of the id's text leaves 1 by 3, or there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        joined, sizes, votes, groups = [], [], [], []
        for text in batch.column(1).to_pylist():
            bag = words(text)
            joined.append(b" ".join(sorted(bag)))
            sizes.append(len(bag))
            votes.append(fixed_votes(text, bag))
            groups.append(group_of(bag))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.binary()), pa.array(sizes, pa.int64()),
                                          pa.array(votes, pa.int64()), pa.array(groups, pa.int64())], ["id", "words", "n", "votes", "group"])


def group_of(bag: set[bytes]) -> int:
    """Equal for copies and most near copies of a text."""
    rare = sorted(xxhash.xxh64_digest(w) for w in bag if len(w) >= GROUP_BYTES)[:GROUP_WORDS]
    if len(rare) < GROUP_WORDS:
        rare = sorted(xxhash.xxh64_digest(w) for w in bag)
    return xxhash.xxh64_intdigest(b"".join(rare)) - (1 << 63)


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_col: str) -> DataFrame:
    """(id, words, n, votes, group, label) of the documents to learn from, as a table;
    texts shrink to their distinct words.  The sampled labels are broadcast:
    LABELLED_ROWS of them are expected, whatever the size of the tables."""
    rows = docs.where(~held_out(id_col) & F.col(text_col).isNotNull())
    kind = docs.schema[id_col].dataType.simpleString()
    bags = rows.select(id_col, text_col).mapInArrow(_bags, f"id {kind}, words binary, n bigint, votes bigint, group bigint")
    usable = labels.where(F.col(toxic_col).isNotNull() & ~held_out(id_col))
    marks = usable.groupBy(F.col(id_col).cast(kind).alias("_id")).agg((F.avg(F.col(toxic_col).cast("double")) >= 0.5).cast("int").alias("label"))
    marks = written(marks.withColumn("_u", unit_hash(F.lit("label sample"), F.col("_id").cast("string"))))
    marks = marks.where(F.col("_u") < LABELLED_ROWS / max(marks.count(), 1)).drop("_u")
    return written(bags.join(F.broadcast(marks), F.col("id") == F.col("_id"), "left").drop("_id"))


# ---- voters ----

def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        every = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([counts[0][w] for w in every], pa.int64()),
                                           pa.array([counts[1][w] for w in every], pa.int64())], ["word", "clean", "toxic"])

    for batch in _slices(batches):
        for bag, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label].update(bag.split())
            if len(counts[0]) + len(counts[1]) > HELD_WORDS:
                yield flush()
                counts[0].clear()
                counts[1].clear()
    yield flush()


def _evidence(counted: DataFrame, usual: float) -> DataFrame:
    """Words with LEAST_DOCS toxic cases or more whose rate of them surely beats
    the usual one, the strongest first."""
    docs = (F.col("clean") + F.col("toxic")).cast("double")
    rate = F.col("toxic") / docs
    lower = (rate + Z * Z / (2 * docs) - Z * F.sqrt((rate * (1 - rate) + Z * Z / (4 * docs)) / docs)) / (1 + Z * Z / docs)
    return (counted.where(F.col("toxic") >= LEAST_DOCS).withColumn("rate", lower)
                   .where(F.col("rate") > min(LEAST_LIFT * usual, (1 + usual) / 2))
                   .orderBy((F.col("rate") * F.sqrt("toxic")).desc(), "word"))


def mine(rows: DataFrame) -> dict[bytes, int]:
    """Word -> its list: the LEXICON_WORDS words of the strongest evidence."""
    labelled = rows.where(F.col("label").isNotNull())
    n = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    if not 0 < n["toxic"] < n["n"]:
        return {}
    usual = n["toxic"] / n["n"]
    counted = labelled.select("words", "label").mapInArrow(_word_counts, "word binary, clean bigint, toxic bigint") \
                      .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    likely = [bytes(r["word"]) for r in _evidence(counted, usual).limit(COUNTED_WORDS).select("word").collect()]
    shared = rows.sparkSession.sparkContext.broadcast(set(likely))

    def cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = [(w, g, y) for bag, g, y in zip(*(c.to_pylist() for c in batch.columns)) for w in shared.value.intersection(bag.split())]
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.int32())], ["word", "group", "label"])

    found = labelled.select("words", "group", "label").mapInArrow(cases, "word binary, group bigint, label int").distinct()
    by_group = found.groupBy("word").agg(F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic"))
    best = _evidence(by_group, usual).limit(LEXICON_WORDS).select("word").collect()
    return {bytes(r["word"]): i % MINED_VOTERS for i, r in enumerate(best)}


def vote_patterns(rows: DataFrame, lexicon: dict[bytes, int]) -> DataFrame:
    """``rows`` with the votes of all voters."""
    shared = rows.sparkSession.sparkContext.broadcast({w: 1 << (len(FIXED) + v) for w, v in lexicon.items()})
    place, bags = rows.columns.index("votes"), rows.columns.index("words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = shared.value
        for batch in _slices(batches):
            votes = []
            for v, bag in zip(batch.column(place).to_pylist(), batch.column(bags).to_pylist()):
                for w in bit.keys() & set(bag.split()):
                    v |= bit[w]
                votes.append(v)
            yield batch.set_column(place, "votes", pa.array(votes, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


# ---- label model ----

def _bits(votes: np.ndarray) -> np.ndarray:
    return ((votes[:, None] >> np.arange(VOTERS)) & 1).astype(np.float64)


class LabelModel:
    """Classes 0 and 1; ``fires[y, j]`` is how often voter j fires in y,
    ``given[y, a, j]`` the same where its parent's vote is a, ``says[y]`` how
    often a label of class y is 1."""

    def __init__(self):
        self.prior, self.parent = 0.1, np.full(VOTERS, -1)
        self.fires = np.full((2, VOTERS), 0.1)
        self.given = np.zeros((2, 2, VOTERS))
        self.says = np.array([0.1, 0.9])
        self.started = False

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Probability of class 1; label is 0, 1 or -1 (none)."""
        v = _bits(votes)
        if not self.started:  # any voter speaks for class 1, a label for itself
            return 1 / (1 + np.exp(3 - 2.0 * v.sum(1) - 2.0 * np.where(label < 0, 0, 2 * label - 1)))
        logs = np.log([1 - self.prior, self.prior])[:, None] + np.zeros((2, len(votes)))
        roots, kids = np.flatnonzero(self.parent < 0), np.flatnonzero(self.parent >= 0)
        over = v[:, self.parent[kids]]
        for y in (0, 1):
            p = self.fires[y, roots]
            logs[y] += v[:, roots] @ np.log(p) + (1 - v[:, roots]) @ np.log(1 - p)
            p = np.where(over > 0, self.given[y, 1, kids], self.given[y, 0, kids])
            logs[y] += np.log(np.where(v[:, kids] > 0, p, 1 - p)).sum(1)
            logs[y] += np.where(label < 0, 0, np.log(np.where(label == 1, self.says[y], 1 - self.says[y])))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def update(self, counts: np.ndarray, labels: np.ndarray, tree: bool) -> None:
        """``counts[y]``: documents in which both voters fire, the last row and
        column being all documents; ``labels[y, a]``: those labelled a."""
        total = counts[:, -1, -1]
        single = np.diagonal(counts, axis1=1, axis2=2)[:, :-1]
        both = counts[:, :-1, :-1]
        self.prior = float(np.clip((total[1] + 1) / (total.sum() + 2), 1e-4, 1 - 1e-4))
        whole = single.sum(0) / max(total.sum(), 1)
        self.fires = np.clip((single + 2 * whole + 1e-3) / (total[:, None] + 2.01), 1e-6, 1 - 1e-6)
        self.says = np.clip((labels[:, 1] + [0.1, 0.9]) / (labels.sum(1) + 1), 1e-3, 1 - 1e-3)
        if tree:
            self.parent = self._tree(total, single, both) if (self.parent < 0).all() else self.parent
            for j in np.flatnonzero(self.parent >= 0):
                p = self.parent[j]
                on, off = both[:, j, p], single[:, j] - both[:, j, p]
                self.given[:, 1, j] = (on + 2 * self.fires[:, j]) / (single[:, p] + 2)
                self.given[:, 0, j] = (off + 2 * self.fires[:, j]) / (total - single[:, p] + 2)
            self.given = np.clip(self.given, 1e-6, 1 - 1e-6)
        self.started = True

    @staticmethod
    def _tree(total, single, both) -> np.ndarray:
        """Maximum spanning forest over conditional mutual information."""
        info = np.zeros((VOTERS, VOTERS))
        n = max(total.sum(), 1)
        for y in (0, 1):
            a, b = single[y][:, None], single[y][None, :]
            t = total[y] + 1e-9
            for joint, pa_, pb in ((both[y], a, b), (a - both[y], a, t - b), (b - both[y], t - a, b), (t - a - b + both[y], t - a, t - b)):
                joint = np.maximum(joint, 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    term = joint / n * np.log(joint * t / (pa_ * pb))
                info += np.where((joint > 0) & np.isfinite(term), term, 0)
        np.fill_diagonal(info, 0)
        parent, inside = np.full(VOTERS, -1), np.zeros(VOTERS, bool)
        best, by = np.zeros(VOTERS), np.full(VOTERS, -1)
        for _ in range(VOTERS):
            j = int(np.argmax(np.where(inside, -1, best)))
            inside[j] = True
            parent[j] = by[j] if best[j] >= LEAST_DEPENDENCE else -1
            closer = ~inside & (info[j] > best)
            best, by = np.where(closer, info[j], best), np.where(closer, j, by)
        return parent


def _expected(model) -> object:
    side = VOTERS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        out = np.zeros(2 * side * side + 4, np.int64)
        for batch in batches:
            votes, label, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            q = np.rint(m.posterior(votes, label) * _UNIT).astype(np.int64)
            v = np.column_stack([_bits(votes), np.ones(len(votes))])
            for y, w in enumerate((_UNIT - q, q)):
                w = (w * n).astype(np.float64)
                out[y * side * side:(y + 1) * side * side] += np.rint((v * w[:, None]).T @ v).astype(np.int64).ravel()
                for a in (0, 1):
                    out[2 * side * side + 2 * y + a] += int(w[label == a].sum())
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "n"])
    return run


def count_patterns(rows: DataFrame) -> DataFrame:
    """(votes, label, n, rows, words): groups, documents and words of each vote pattern, as a table."""
    per_group = rows.groupBy("votes", F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"), "group") \
                    .agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("words"))
    return written(per_group.groupBy("votes", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.sum("words").alias("words")))


def fit_label_model(counted: DataFrame) -> LabelModel:
    """Expectation maximisation over vote patterns (votes, label, n)."""
    counted = counted.select("votes", "label", "n")
    model, side = LabelModel(), VOTERS + 1
    for r in range(ROUNDS + TREE_ROUNDS):
        shared = counted.sparkSession.sparkContext.broadcast(model)
        sums = np.zeros(2 * side * side + 4)
        for x in counted.mapInArrow(_expected(shared), "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
            sums[x["at"]] = x["n"] / _UNIT  # a row a pair of voters and class
        shared.unpersist()
        model.update(sums[:2 * side * side].reshape(2, side, side), sums[2 * side * side:].reshape(2, 2), r >= ROUNDS)
    if model.fires[1].sum() < model.fires[0].sum():  # class 1 is the one that voters fire in
        model.prior, model.fires, model.given, model.says = 1 - model.prior, model.fires[::-1], model.given[::-1], model.says[::-1]
    return model


# ---- classifier ----

def word_features(word: bytes) -> list[int]:
    """The numbers of a word's features."""
    parts = [word + b" ", *(word[:n] for n in BEGINNINGS if len(word) > n)]
    return [xxhash.xxh64_intdigest(p) >> (64 - DIM_BITS) for p in parts]


def features(bag) -> np.ndarray:
    return np.array(sorted({f for word in bag for f in word_features(word)}), np.int64)


def fit_ftrl(rows: list[np.ndarray], target: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of the features and, last, the bias; targets are probabilities."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    l1 = np.full(DIM + 1, L1)
    l1[-1] = 0.0

    def current(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1[at], 0.0, (np.sign(zi) * l1[at] - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at = np.append(rows[i], DIM)
            w = current(at)
            g = weights[i] * (1 / (1 + np.exp(-np.clip(w.sum(), -50, 50))) - target[i])
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return current(np.arange(DIM + 1))


def fit_scale(logits: np.ndarray, target: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(a, b) of the calibrated logit a * x + b, by short Newton steps with a weak pull to (1, 0)."""
    ab = np.array([1.0, 0.0])
    x = np.column_stack([logits, np.ones(len(logits))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -50, 50)))
        grad = x.T @ (weights * (p - target)) + 1.0 * (ab - [1, 0])
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + np.eye(2)
        ab = ab - np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        ab[0] = np.clip(ab[0], *SLOPES)
    return float(ab[0]), float(ab[1])


class Classifier:
    def __init__(self, weights: np.ndarray, scale: tuple[float, float]):
        self.weights, self.bias, self.scale = weights[:-1].astype(np.float64), float(weights[-1]), scale
        self._known: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return {"at": at, "w": self.weights[at], "bias": self.bias, "scale": self.scale}

    def __setstate__(self, state):
        self.weights, self.bias, self.scale, self._known = np.zeros(DIM), state["bias"], state["scale"], {}
        self.weights[state["at"]] = state["w"]

    def score(self, text: str | None) -> float:
        at: set[int] = set()
        for word in words(text or ""):
            found = self._known.get(word)
            if found is None:
                if len(self._known) >= CACHED_WORDS:
                    self._known.clear()
                found = self._known[word] = tuple(f for f in word_features(word) if self.weights[f])
            if found:
                at.update(found)
        x = self.bias + float(self.weights[sorted(at)].sum()) if at else self.bias
        return float(1 / (1 + np.exp(-np.clip(self.scale[0] * x + self.scale[1], -50, 50))))


def _judged(model) -> object:
    """(votes, label, others) -> (q, others)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in _slices(batches):
            votes, label = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(m.posterior(votes, label)), *batch.columns[2:]], ["q", *batch.schema.names[2:]])
    return run


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        at = [features(b.split()).astype("<u4").tobytes() for b in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), *batch.columns[1:]], ["at", "q", "group"])


def training_sample(rows: DataFrame, counted: DataFrame, model: LabelModel) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Features, posteriors, weights, and which are for calibration, of a sample
    of ``rows``; of the sampled rows of a group one stays."""
    judged = _judged(rows.sparkSession.sparkContext.broadcast(model))
    side = F.col("q") >= 0.5
    sizes = {r["side"]: r for r in counted.select("votes", "label", "rows", "words").mapInArrow(judged, "q double, rows bigint, words bigint")
             .groupBy(side.alias("side")).agg(F.sum("rows").alias("rows"), F.sum("words").alias("n")).collect()}
    shares = {s: min(1.0, SAMPLE_ROWS / r["rows"], SAMPLE_WORDS / max(r["n"], 1)) for s, r in sizes.items()}
    share = F.when(side, F.lit(shares.get(True, 1.0))).otherwise(F.lit(shares.get(False, 1.0)))
    draw = unit_hash(F.lit("toxicity sample"), F.col("id").cast("string"))
    drawn = rows.select("votes", F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"), "words", "group", draw.alias("u")) \
                .mapInArrow(judged, "q double, words binary, group bigint, u double")
    picked = drawn.where(F.col("u") < share).select("words", "q", "group").mapInArrow(_featured, "at binary, q double, group bigint").collect()
    picked.sort(key=lambda r: (r["group"], r["q"], bytes(r["at"])))
    ones = [rows_[len(rows_) // 2] for rows_ in _grouped(picked)]
    x = [np.frombuffer(r["at"], "<u4").astype(np.int64) for r in ones]
    q = np.array([r["q"] for r in ones])
    w = np.array([1 / shares[r["q"] >= 0.5] for r in ones])
    return x, q, w, np.array([r["group"] % 1000 < 1000 * CALIBRATION_SHARE for r in ones], bool)


def _grouped(rows: list) -> Iterator[list]:
    """Runs of equal group."""
    at = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i]["group"] != rows[at]["group"]:
            yield rows[at:i]
            at = i


def fit_classifier(x: list[np.ndarray], q: np.ndarray, w: np.ndarray, unseen: np.ndarray) -> Classifier:
    if not len(x):
        return Classifier(np.zeros(DIM + 1), (1.0, -2.0))
    seen = np.flatnonzero(~unseen)
    weights = fit_ftrl([x[i] for i in seen], q[seen], (w / w.mean())[seen])
    logits = np.array([weights[x[i]].sum() + weights[-1] for i in np.flatnonzero(unseen)])
    return Classifier(weights, fit_scale(logits, q[unseen], w[unseen]) if unseen.any() else (1.0, 0.0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Classifier:
    """Learn from the documents not held out.  A document labelled more than
    once takes its mean label; null labels, and those of unknown ids, say
    nothing.  Without any label the fixed voters alone teach; without any
    document all scores are one low value."""
    rows = learning_rows(docs, labels, id_col, text_col, toxic_col)
    rows = vote_patterns(rows, mine(rows))
    counted = count_patterns(rows)
    return fit_classifier(*training_sample(rows, counted, fit_label_model(counted)))


def score(df: DataFrame, model: Classifier, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` with score (0 to 1) and predicted (1 from ``threshold``
    on) after their columns; a taken name gets leading underscores.  A null or
    empty text has the score of a text without words."""
    name, hit = free_name(df, "score", "predicted")
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            scores = [shared.value.score(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()),
                                              pa.array([int(s >= threshold) for s in scores], pa.int32())], [*batch.schema.names, name, hit])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType()), T.StructField(hit, T.IntegerType())]))
