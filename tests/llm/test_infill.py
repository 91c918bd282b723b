"""Fill-in-middle against a per-text version: cuts, outputs and round trips."""

import hashlib
import random
import re

import pytest

from linkstream.llm import infill
from linkstream.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm.test_operators import docs, edge, empty  # noqa: F401  (fixtures)


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:lo], tokens[lo:hi], tokens[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df):
    rows = df.select("doc_id", "text").collect()
    got = sorted(map(tuple, infill.restore(infill.transform(df)).collect()), key=str)
    want = sorted(((*brute(r["doc_id"], r["text"]), r["text"] or "") for r in rows), key=str)
    assert got == want


def odd_texts(n):
    rng = random.Random(5)
    parts = ["<", ">", "<P", "P>", "<S>", "<M>", "<P>", "a", "bc ", "é", "ß", "😀", "\n", " ", "İ", "x1", "́", "日本"]
    return [(i, "".join(rng.choices(parts, weights=[4, 4, 4, 4, .2, .2, .2] + [4] * 11, k=rng.randrange(0, 30)))) for i in range(n)]


def test_matches_per_text_version(docs, edge):  # noqa: F811
    check(docs)
    check(edge)


def test_odd_texts(spark):
    check(spark.createDataFrame(odd_texts(3000), "doc_id bigint, text string"))


@pytest.mark.parametrize("window,size", [(1, 1), (3, 50), (7, 1000)])
def test_small_windows_and_buffers(monkeypatch, window, size):
    """Cuts, sentinels and moves that cross windows; run here, not in workers."""
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(infill, "WINDOW", window)
    monkeypatch.setattr(infill, "BUFFER_BYTES", size)
    rows = odd_texts(400)
    batch = pa.record_batch([pa.array([t for _, t in rows], pa.string())], ["t"])
    at = 0
    for piece in infill._pieces(batch, 0):
        some = rows[at:at + piece.num_rows]
        at += piece.num_rows
        h = np.array([[int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for i, _ in some] for k in range(4)])
        made = infill.scatter(piece.column(0), h)
        assert [tuple(x) for x in zip(*(c.to_pylist() for c in made))] == [brute(i, t)[1:] for i, t in some]
        assert infill.gather(made[4], made[1].to_numpy(zero_copy_only=False)).to_pylist() == [t for _, t in some]
    assert at == len(rows)


def test_shares_and_empty_table(spark, empty):  # noqa: F811
    forms = infill.transform(spark.range(20_000).selectExpr("id as doc_id", "'some words here' as text")).groupBy("form").count()
    n = {r["form"]: r["count"] for r in forms.collect()}
    assert abs(n["plain"] - 2000) < 200 and abs(n["spm"] - 3600) < 250
    assert infill.transform(empty).count() == 0


def test_broken_output_is_an_error(spark):
    bad = spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="one sentinel of each kind"):
        infill.restore(bad).collect()


def test_query_digests(spark, docs):  # noqa: F811
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(map(tuple, QUERIES["op12_infill"](spark, SF001).collect()), key=str)
    want = []
    for r in docs.collect():
        *head, out = brute(r["doc_id"], r["text"])
        want.append((*head, sha(out), sha(r["text"] or "")))
    assert got == sorted(want, key=str)
