"""Weak supervision: the voters, the label model against a plain version, held-out accuracy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkstream.llm import toxicity as X
from linkstream.llm.queries import QUERIES
from linkstream.sources.tables import read_table
from tests.conftest import SF01
from tests.llm.test_operators import edge, empty  # noqa: F401  (fixtures)


def test_words_and_votes():
    assert X.words("You IDIOT, you “Clown”!\nÉcole x1y «idiot» L'eau") == {
        b"you", b"idiot", b"clown", "école".encode(), b"x", b"y", b"l", b"eau"}
    votes = lambda t: {X.FIXED[i] for i in range(len(X.FIXED)) if X.fixed_votes(t, X.words(t)) >> i & 1}
    assert votes("") == set() and votes("a clowning idiomatic text") == set()
    assert votes("You're such a pathetic Loser!!") == {"addressed", "worth", "insults twice", "shouting"}
    assert votes("what a basura") == {"spanish"}
    assert votes("I hate you, f**k") == {"contempt", "masked"}
    assert X.VOTERS <= 63


def simulated(n, seed=0):
    """Votes of independent voters, of two that copy each other, and noisy labels on some rows."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.2
    rates = {0: (0.02, 0.7), 1: (0.05, 0.6), 2: (0.01, 0.5), 5: (0.1, 0.1), 20: (0.03, 0.4)}
    votes = np.zeros(n, np.int64)
    for j, (a, b) in rates.items():
        votes |= (rng.random(n) < np.where(y, b, a)).astype(np.int64) << j
    same = (votes & 1) ^ (rng.random(n) < 0.03)
    votes |= same.astype(np.int64) << 30
    label = np.where(rng.random(n) < 0.4, np.where(rng.random(n) < 0.1, ~y, y).astype(int), -1)
    return y, votes, label, rates


def test_label_model_finds_accuracies_and_dependence(spark):
    y, votes, label, rates = simulated(20_000)
    rows = spark.createDataFrame([(int(v), None if a < 0 else int(a)) for v, a in zip(votes, label)], "votes bigint, label int")
    m = X.fit_label_model(X.count_patterns(rows.withColumn("n", F.lit(1)).withColumn("group", F.monotonically_increasing_id())))
    assert abs(m.prior - 0.2) < 0.03
    for j, (a, b) in rates.items():
        assert abs(m.fires[0, j] - a) < 0.03 and abs(m.fires[1, j] - b) < 0.06
    assert m.says[0] < 0.2 and m.says[1] > 0.8
    assert m.parent[30] == 0 or m.parent[0] == 30  # the copies hang on each other
    q = m.posterior(votes, np.full(len(votes), -1))
    assert ((q > 0.5) == y).mean() > 0.88


def test_posterior_against_enumeration():
    """Of a model with a tree: prior and conditional tables multiplied out."""
    rng = np.random.default_rng(3)
    m = X.LabelModel()
    m.prior, m.started = 0.3, True
    m.fires, m.given, m.says = rng.uniform(.1, .9, (2, X.VOTERS)), rng.uniform(.1, .9, (2, 2, X.VOTERS)), np.array([.2, .7])
    m.parent[5], m.parent[7], m.parent[9] = 2, 5, 2
    votes = rng.integers(0, 1 << 12, 50)
    for label in (-1, 0, 1):
        got = m.posterior(votes, np.full(50, label))
        for v, q in zip(votes, got):
            p = np.array([.7, .3])
            for y, j in itertools.product((0, 1), range(X.VOTERS)):
                bit = v >> j & 1
                rate = m.fires[y, j] if m.parent[j] < 0 else m.given[y, v >> m.parent[j] & 1, j]
                p[y] *= rate if bit else 1 - rate
            if label >= 0:
                p *= m.says if label else 1 - m.says
            assert q == pytest.approx(p[1] / p.sum(), rel=1e-6)


def test_ftrl_is_weighted_logistic_regression():
    """Close to the least loss that plain gradient descent finds, without penalties that matter."""
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(3000)]
    truth = rng.normal(size=12)
    target = np.array([1 / (1 + np.exp(-truth[r].sum())) for r in rows])
    w = X.fit_ftrl(rows, target, np.ones(3000))
    p = np.array([1 / (1 + np.exp(-(w[r].sum() + w[-1]))) for r in rows])
    assert np.abs(p - target).mean() < 0.05


def fitted(spark, docs, labels):
    return X.fit(docs, labels)


def test_held_out_accuracy_and_label_use(spark):
    docs, labels = read_table(spark, SF01, "documents"), read_table(spark, SF01, "labels")
    model = fitted(spark, docs, labels)
    # other labels of the held-out rows, and other columns, change nothing
    flipped = labels.withColumn("toxic", F.when(X.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = fitted(spark, docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), flipped)
    assert np.array_equal(model.weights, again.weights) and model.scale == again.scale
    got = QUERIES["op11_toxicity"](spark, SF01).join(labels, "doc_id").select("held_out", "score", "predicted", "toxic").toPandas()
    held = got[got.held_out]
    rank = held.score.rank()
    ones, zeros = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    auc = (rank[held.toxic == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)
    assert auc > 0.85 and held.toxic[held.predicted == 1].mean() > 0.9
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()


def test_insults_are_caught_and_clean_texts_left(spark):
    docs, labels = read_table(spark, SF01, "documents"), read_table(spark, SF01, "labels")
    model = fitted(spark, docs, labels)
    assert model.score("You are a stupid, worthless idiot and a pathetic clown.") > 0.7
    for clean in ("", None, "The weather is fine today, thank you.", "12 %% 34", " ".join(f"w{i}" for i in range(20_000))):
        assert model.score(clean) < 0.3


def test_edges(spark, edge, empty):  # noqa: F811
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, None), (5, 0, 1), (5, 0, 0), (None, 0, 1), (999, 1, 1), (3, None, 1)],
                                   "doc_id bigint, quality int, toxic int")
    none = labels.where("false")
    for docs, marks in itertools.product((edge, empty), (labels, none)):
        model = X.fit(docs, marks)
        out = X.score(edge, model)
        rows = out.collect()
        assert out.columns == [*edge.columns, "_score", "predicted"] and len(rows) == edge.count()
        assert all(0 <= r["_score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        assert len({r["_score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert X.score(empty, model).count() == 0


def test_unlabelled_corpus_learns_from_the_fixed_voters(spark):
    rng = np.random.default_rng(4)
    plain, bad = [f"word{i}" for i in range(60)], ["idiot", "loser", "scum", "moron", "trash", "clown"]
    rows = [(i, " ".join([*rng.choice(plain, 30), *(rng.choice(bad, 3) if i % 8 == 0 else [])])) for i in range(1500)]
    docs = spark.createDataFrame([(int(a), str(b)) for a, b in rows], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    out = X.score(docs, X.fit(docs, none)).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 8 == 0) for r in out]) > 0.95


def test_copies_of_a_mislabelled_text_teach_no_words(spark):
    """A thousand copies of one wrongly labelled text are one case; insults in many texts are many."""
    rng = np.random.default_rng(9)
    letters = ["".join(chr(97 + i // 26 ** k % 26) for k in range(3)) for i in range(400)]
    plain, wrong = [f"plainword{x}" for x in letters], " ".join(f"innocentword{x}" for x in letters[:40])
    rows = [(i, " ".join(rng.choice(plain, 30)) + (" moronic text" if i % 6 == 0 else ""), int(i % 6 == 0)) for i in range(900)]
    rows += [(5000 + i, wrong + f" plain{i % 9}", 1) for i in range(1000)]
    df = spark.createDataFrame([(int(a), str(b), int(c)) for a, b, c in rows], "doc_id bigint, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    lexicon = X.mine(X.learning_rows(docs, labels, "doc_id", "text", "toxic"))
    assert b"moronic" in lexicon and not any(w.startswith(b"innocent") for w in lexicon)
    # copies, edited ones too, mostly fall into one group
    bag = X.words(wrong)
    assert X.group_of(bag) == X.group_of(X.words(wrong.upper() + " a b"))
