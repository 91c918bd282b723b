"""Operators that SQL cannot express, against a second, plain form of them."""

import hashlib
import math
import os
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkstream.llm import language, neardup, quality, secrets, sharding
from linkstream.llm.queries import QUERIES, op10_quality_rules
from linkstream.sources.tables import read_table
from tests.conftest import SF001, SF01
from tests.llm.test_operators import docs, edge, empty  # noqa: F401  (fixtures)
from tests.test_features import eager_skew, final_plan  # noqa: F401  (fixtures)


# ---- 2: the descent of the tree ----

def plain_shard(doc_id, shards, extra):
    """Region, rack, shard: at each level the least exponential draw by weight wins."""
    def u(label):
        return (int(hashlib.md5(f"0|{doc_id}|{label}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52

    leaves = [(0, s) for s in range(shards)] + ([(1, shards)] if extra else [])
    for path in (lambda g, s: f"g{g}/r{s // 10}", lambda g, s: f"g{g}/r{s // 10}/k{s // 5}", lambda g, s: f"g{g}/r{s // 10}/k{s // 5}/s{s}"):
        below = defaultdict(list)
        for leaf in leaves:
            below[path(*leaf)].append(leaf)
        leaves = below[min(below, key=lambda label: -math.log(u(label)) / len(below[label]))]
    return leaves[0][1]


def test_shards_against_a_plain_descent(spark):
    got = QUERIES["op2_sharding"](spark, SF001).select("doc_id", "shard", "grown_shard").distinct().collect()
    assert len(got) > 100
    for r in got:
        assert r["shard"] == plain_shard(r["doc_id"], 40, False) and r["grown_shard"] == plain_shard(r["doc_id"], 40, True)


def test_weights_change_only_their_subtree(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"))
    tree = sharding.build_tree(20)
    less = sharding.set_weight(tree, 7, 0.25)
    moved = ids.select(sharding.shard_of(F.col("doc_id"), tree).alias("a"), sharding.shard_of(F.col("doc_id"), less).alias("b")).where("a <> b")
    assert moved.count() > 0 and moved.where("a not between 0 and 9").count() == 0  # region of shard 7
    assert moved.where("a not between 5 and 9 and b between 0 and 9").count() == 0  # its rack gives to the others


# ---- 3: features, fit and prediction ----

def plain_grams(text):
    """Grams of 1 to 3 of lower-case letters, other runs being one separator (0)."""
    seq, out = [0, 0], Counter()
    for ch in text:
        c = ord(ch.lower()[0]) if ch.isalpha() else 0
        if not c and not seq[-1]:
            continue
        seq.append(c)
    m = 0xFFFFFFFF
    for a, b, c in zip(seq, seq[1:], seq[2:]):
        two = (b * 0x9E3779B1 + c * 0x85EBCA77) & m
        three = (a * 0xC2B2AE3D + two) & m
        grams = [two ^ (two >> 15), three ^ (three >> 13)] + ([c * 0x27D4EB2F & m] if c else [])
        for g in grams:
            out[(g * 0x165667B1 & m) >> (32 - language.DIM_BITS)] += 1
    return out


def test_grams_against_a_plain_count(docs):  # noqa: F811
    for t in [r["text"] or "" for r in docs.limit(40).collect()] + ["", "a", "Éé ß x1y", "  ab  c "]:
        counts = language.gram_counts(t)
        assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == dict(plain_grams(t))


def plain_ftrl(rows, labels, classes):
    """Follow the regularised leader, one weight at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(c, f):
        if abs(z[c, f]) <= language.L1:
            return 0.0
        return (math.copysign(language.L1, z[c, f]) - z[c, f]) / ((language.BETA + math.sqrt(n[c, f])) / language.ALPHA + language.L2)

    for epoch in range(language.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            x = [*zip(map(int, rows[i][0]), map(float, rows[i][1])), (language.DIM, 1.0)]
            w = [{f: weight(c, f) for f, _ in x} for c in range(classes)]
            s = [sum(w[c][f] * v for f, v in x) for c in range(classes)]
            e = [math.exp(v - max(s)) for v in s]
            for c in range(classes):
                err = e[c] / sum(e) - (labels[i] == c)
                for f, v in x:
                    g = err * v
                    grown = n[c, f] + g * g
                    z[c, f] += g - (math.sqrt(grown) - math.sqrt(n[c, f])) / language.ALPHA * w[c][f]
                    n[c, f] = grown
    return weight


def test_fit_against_a_plain_fit(monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 2)
    rng = np.random.default_rng(0)
    idf = np.ones(language.DIM)
    words = [["alpha", "beta", "gamma"], ["lorem", "ipsum", "dolor"], ["uno", "dos", "tres"]]
    labels = rng.integers(0, 3, 60)
    rows = [language._features(language.gram_counts(" ".join(rng.choice(words[y], 4))), idf) for y in labels]
    fitted, plain = language.fit_ftrl(rows, labels, 3), plain_ftrl(rows, labels, 3)
    for f in {int(f) for r in rows for f in r[0]} | {language.DIM}:
        for c in range(3):
            assert fitted[c, f] == pytest.approx(plain(c, f), abs=1e-9)


def test_prediction_against_a_plain_softmax(docs):  # noqa: F811
    model = language.fit(docs)
    for t in [r["text"] for r in docs.limit(30).collect() if r["text"]]:
        x = {f: (1 + math.log(n)) * model.idf[f] for f, n in plain_grams(t).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        s = [(sum(model.weights[c, f] * v / norm for f, v in x.items()) + model.weights[c, -1]) / model.temperature for c in range(len(model.langs))]
        p = [math.exp(v - max(s)) / sum(math.exp(y - max(s)) for y in s) for v in s]
        lang, score = model.predict(t)
        if language.has_letter(t):
            assert lang == model.langs[int(np.argmax(p))] and score == pytest.approx(max(p))


def test_temperature_is_the_best_of_many():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(300, 3)) * 4
    labels = np.array([rng.choice(3, p=np.exp(z / 2) / np.exp(z / 2).sum()) for z in logits])  # a temperature of about 2

    def loss(t):
        e = np.exp(logits / t - (logits / t).max(1, keepdims=True))
        return -np.log(e[np.arange(300), labels] / e.sum(1)).mean()

    best = language.fit_temperature(logits, labels)
    assert loss(best) <= min(loss(t) for t in np.exp(np.linspace(-3, 3, 400))) + 1e-6


# ---- 10: score and verdict ----

def test_quality_scores_and_verdicts_against_plain_counts(spark, monkeypatch):
    m = (1 << 64) - 1

    def buckets(text):
        h = [xxhash.xxh64_intdigest(w) for w in (text or "").encode().split()]
        out = list(h)
        for a, b in zip(h, h[1:]):
            p = (a * 0x9E3779B97F4A7C15 + b) & m
            p ^= p >> 29
            out.append(p * 0xBF58476D1CE4E5B9 & m)
        return [x >> 49 for x in out]

    table, labels = read_table(spark, SF01, "documents"), read_table(spark, SF01, "labels").collect()
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    good = {r["doc_id"]: r["quality"] >= 1 and not r["toxic"] for r in labels}
    raw, target = Counter(), Counter()
    for d, t in texts.items():
        raw.update(buckets(t))
        if good.get(d):
            target.update(buckets(t))
    n_raw, n_target, size = sum(raw.values()), sum(target.values()), quality.BUCKETS

    def ratio(b):
        p = (raw[b] + quality.SMOOTH) / (n_raw + quality.SMOOTH * size)
        return round(math.log((target[b] + quality.SMOOTH * size * p) / (n_target + quality.SMOOTH * size) / p), 9)

    got = {r["doc_id"]: r for r in op10_quality_rules(spark, SF01).collect()}
    for d, t in texts.items():
        b = buckets(t)
        assert got[d]["score"] == pytest.approx(sum(map(ratio, b)) / len(b) if b else 0.0, abs=2e-9)
    # the threshold keeps nearly all good ones and drops most of the others
    scored = [(math.floor(max(-quality.SPAN, min(quality.SPAN, got[d]["score"])) * quality.STEPS), good[d])
              for d in good if d in got and not got[d]["base_failed"]]
    allowed = (1 - quality.KEEP_TRUSTED) * sum(g for _, g in scored)
    best, most = -math.inf, 0
    for step in sorted({s for s, _ in scored}):
        if sum(g for s, g in scored if s <= step) > allowed:
            break
        if (n := sum(not g for s, g in scored if s <= step)) > most:
            best, most = (step + 1) / quality.STEPS, n
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= best) for r in got.values())


def test_many_new_words_keep_their_hashes():
    w = quality.Words()
    for i in range(40):
        w.numbers([f"w{j}".encode() for j in range(i * 700, i * 700 + 900)])
    assert all(int(w.hashes[n]) == xxhash.xxh64_intdigest(k) for k, n in w.items())


# ---- hot keys ----

def test_a_hot_text_is_split_in_the_secret_scan(spark, eager_skew):  # noqa: F811
    hot = "password=abcdef123 " * 3
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"),
                                      F.when(F.col("id") % 2 == 0, hot).otherwise(F.concat(F.lit("token=abcdef"), F.col("id") % 700)).alias("text"))
    out = secrets.scan(rows.repartition(8))
    assert "skew=true" in final_plan(out) and out.where("n_assign > 0").count() == 40_000


def test_groups_of_several_blocks_keep_all_links(spark, monkeypatch):
    """Blocks of a few members, and groups of one block beside them."""
    from tests.llm.test_operators import brute_links
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 7] + ["x"] + base[i % 7 + 1:])) for i in range(30)]
    rows += [(100 + i, " ".join(f"v{i // 2}_{j}" for j in range(40)) + (" end" if i % 2 else "")) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in neardup.join(df).collect())
    assert got == sorted(brute_links(rows))


# ---- the entry without a module that only the corpus operators need ----

def test_entry_loads_without_a_module_of_the_corpus_operators():
    code = ("import sys; sys.modules['xxhash'] = None\n"
            "import __spark_entry__ as E\n"
            "names = E.queries()\n"
            "assert len(names) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in names), names\n"
            "assert set(E.oracle_sql()) <= set(names)")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
