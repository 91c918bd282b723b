"""Ranked lexical search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from linkstream.llm import lexical
from linkstream.sources.tables import read_table
from tests.conftest import SF001
from tests.llm.test_operators import docs, edge, empty  # noqa: F401  (fixtures)

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, k):
    counted = [(d, Counter(w), len(w)) for d, t in rows if (w := words(t))]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in counted:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in set(words(text)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d, s))
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def check(docs, items, k=50):  # noqa: F811
    got = sorted(map(tuple, lexical.search(docs, items, k).collect()), key=str)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").distinct().collect()], k)
    assert got == want
    return got


def test_terms_match_the_pattern():
    for t in ["Ab-c_9 ÉCOLE x\x85y", "İ ß日本 a\x7fb", "", "...", "\ud800"]:
        assert [w.decode("utf-8", "surrogatepass") for w in lexical.terms(t)] == words(t)


def test_whole_table(spark, docs):  # noqa: F811
    assert check(docs, read_table(spark, SF001, "benchmark"))


def test_edges(spark, edge, empty):  # noqa: F811
    items = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, "nowhere-at-all"), (5, "w7 w19999 END"),
                                   (6, "é 😀"), (None, "more"), (7, "A"), (7, "12")], "item_id bigint, text string")
    for k in (1, 3, 50):
        check(edge, items, k)
    assert check(empty, items) == []
    assert check(edge, items.where("false")) == []


def test_ties_levels_and_repeats(spark):
    """Many copies, terms of every level, and scores that differ by a term's count only."""
    rows = [(i, " ".join(["cat"] * (1 + i % 40) + ["dog"] * (i % 3) + [f"x{j}" for j in range(i % 7)])) for i in range(600)]
    rows += [(10_000 + i, "cat dog fish") for i in range(300)] + [(5, rows[5][1])] * 4
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)  # noqa: F811
    items = spark.createDataFrame([(1, "cat"), (2, "dog cat"), (3, "fish"), (4, "x5 x6 cat"), (5, "dog dog")], "item_id int, text string")
    check(docs, items, 50)
    check(docs, items, 7)


def test_more_items_than_a_group(spark, docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(lexical, "GROUP_BYTES", 1500)
    check(docs, read_table(spark, SF001, "benchmark").limit(12), 10)


@pytest.mark.parametrize("bits", [64, 1 << 22])
def test_bounds_hold(bits, monkeypatch):
    """Of every document, also with signatures that are far too full."""
    import pyarrow as pa
    monkeypatch.setattr(lexical, "MAX_BITS", bits)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.3, rng.integers(1, 200)) % 500) for _ in range(300)]
    counted = [Counter(lexical.terms(t)) for t in texts]
    df = Counter(t for c in counted for t in c)
    items = lexical.Items([lexical.terms(" ".join(f"t{x}" for x in range(i, i + 12))) for i in range(0, 400, 5)], df, 300,
                          sum(map(len, map(lexical.terms, texts))))
    seen = 0
    for b, slices, ids, _, n, *_ in lexical._blocks(pa.array(range(300)), pa.array(range(300)), texts):
        bounds = items.bounds(b, slices, n)
        for j, d in enumerate(ids.to_pylist()):
            exact = items.scores(counted[d], int(n[j]), np.arange(80))
            assert (bounds[:, j] >= exact).all()
            if bits > 64:  # tight enough to exclude
                assert bounds[:, j].sum() <= 1.5 * exact.sum() + 1e6
            seen += 1
    assert seen == 300
