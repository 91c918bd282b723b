"""The registered corpus queries against DuckDB, and the pipeline stage by stage."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkstream.llm import language
from linkstream.llm.queries import ORACLES, QUERIES
from linkstream.sources.tables import read_table
from tests.conftest import SF01, SF001
from tests.oracle_check import compare, duck_connection


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF01)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    _, problems = compare(spark, con, name, QUERIES[name], ORACLES[name], SF01)
    assert not problems, problems


def test_registered_in_the_entry():
    import __spark_entry__ as E
    assert set(QUERIES) <= set(E.queries()) and len(QUERIES) == 14


def test_pipeline_stages(spark):
    docs = read_table(spark, SF001, "documents").cache()
    by_id = {r["doc_id"]: r for r in docs.collect()}
    out, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = out
        out = stage(spark, out, SF001)
        out.cache()
        seen.append((before, out))
        if name != "packing":
            assert out.columns == docs.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    # 1: only texts without a letter go
    with_letter = sorted(d for d, r in by_id.items() if language.has_letter(r["text"] or ""))
    assert ids(seen[0][1]) == with_letter
    # 2: the least id of each group stays
    from tests.llm.test_operators import brute_links
    groups = brute_links([(d, by_id[d]["text"]) for d in with_letter])
    assert ids(seen[1][1]) == sorted({g for _, g, _ in groups})
    # 3: every document stays, without its base secrets
    assert ids(seen[2][1]) == ids(seen[1][1])
    for r in seen[2][1].collect():
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"]) and r["n_chars"] == len(r["text"])
    # 4: copies of documents only
    assert set(ids(seen[3][1])) <= set(ids(seen[2][1]))
    # 5: a first piece for each copy
    assert sorted(r["doc_id"] for r in seen[4][1].where("start = 0").collect()) == ids(seen[3][1])


def test_short_and_mixed_documents_stay(spark):
    """Six languages: a text that could be any of them has a low score, and stays."""
    words = ["lorem", "amet", "dolor", "sic", "vox", "nox", "pax", "lux"]
    rows = [(i, " ".join(words[(i + j * j) % 8] for j in range(1 + i % 9)), f"l{i * 7 % 6}") for i in range(240)]
    rows += [(300, "a", None), (301, "lorem nox xyz", None), (302, "12 %%", None), (303, "", "l1"), (304, None, "l1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF001).collect())
    assert got == [*range(240), 300, 301]


def test_unlabelled_documents_stay(spark):
    """Without any language to learn, only texts without a letter go; with one, null languages are filled."""
    rows = [(i, f"some clean words of document {i}", None) for i in range(20)] + [(30, "12 %%", None), (31, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = corpus_pipeline.language_id(spark, docs, SF001).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(20)] and all(r["lang"] is None for r in got)
    learned = docs.withColumn("lang", F.when(F.col("doc_id") < 18, "en"))
    got = corpus_pipeline.language_id(spark, learned, SF001).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(20)] and {r["lang"] for r in got} == {"en"}


def test_pipeline_runs(spark):
    assert QUERIES["pipeline"](spark, SF001).count() > 0
