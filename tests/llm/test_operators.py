"""The corpus operators against brute force, on edge cases and on sf0.001."""

import hashlib
import html as _html
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstream.llm import language, mixing, neardup, packing, quality, secrets, sharding, topk, urlfilter, wrappers
from linkstream.sources.tables import read_table
from tests.conftest import SF001

LONG = " ".join(f"w{i}" for i in range(20_000))
COPY = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [None, "", " \t\n", "a", "12 %% 34", COPY, COPY, COPY.upper(), COPY + " more", LONG, LONG + " end",
         'token = "abcdef123" x AKIA' + "A" * 16, "é" * 70 + " 😀 ß"]
#: Extra columns whose names the operators use themselves.
EXTRA = ["k", "spans", "node", "copy", "rate", "shard", "slot", "lang_pred", "score", "rank", "_key", "copies"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in EXTRA]])


def edge_rows():
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "a", "b"][i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, COPY, None, "a", 5), (None, None, None, None, None), (None, None, None, None, None)]
    return [r + tuple(EXTRA) for r in rows]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF001, "documents")


# ---- 1 secrets ----

def brute_base(text):
    text = text or ""
    found = []
    for rank, (kind, pattern, least, group) in enumerate([
            ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
            ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)]):
        for m in re.finditer(pattern, text):
            if len(m.group(group)) >= least:
                found.append((m.start(), rank, m.end(), kind))
    found.sort()
    counts = [sum(x[1] == r for x in found) for r in range(3)]
    listing = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return (*counts, hashlib.sha256(listing.encode()).hexdigest())


def test_secret_base_spans(spark, docs, edge):
    odd = ["token=token:abcdef", "TOKEN  ==abcdefg", "ſecret=abcdefgh password='x' passwd:\"abcdef\"", "AKIAAKIA" + "B" * 12 + " akia",
           "f" * 23 + " " + "0a" * 12 + "G" + "e" * 30, "é😀 api_key: 0123456789abcdef0123456789abcdef!", "api-key=abcdefgh apikey=abcde"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    for df in (docs, edge, more):
        got = sorted((tuple(r) for r in secrets.scan(df).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()), key=str)
        want = sorted(((r["doc_id"], *brute_base(r["text"])) for r in df.select("doc_id", "text").collect()), key=str)
        assert got == want


def test_weak_parts_need_their_complement(spark):
    far = " x" * 200
    rows = [(1, "user=alice then k9Jd82mQpLx03VbnTT here"), (2, "k9Jd82mQpLx03VbnTT alone"),
            (3, "user=alice" + far + " k9Jd82mQpLx03VbnTT"), (4, "https://db.example.com/x user=bob password=hunter22"),
            (5, "https://db.example.com/x only"), (6, "user=bob password=hunter22")]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == "identifier:0:10,token:16:34"
    assert got[2] == got[3] == got[5] == ""
    assert [x.split(":")[0] for x in got[4].split(",")] == ["endpoint", "identifier", "assign"]
    assert [x.split(":")[0] for x in got[6].split(",")] == ["identifier", "assign"]


def test_a_part_is_not_its_own_complement(spark):
    """Overlapping parts prove nothing about each other; parts that touch or stand apart do."""
    rows = [(1, "see account: section-12-of-the-manual for help"), (2, "login=k9Jd82mQpLx03VbnTT"),
            (3, "https://example.com/docs/section-12-of-the-manual?page=2"),
            (4, "postgres://user:abcdefgh12345678@db.example.com/x"),
            (5, "login=k9Jd82mQpLx03VbnTT and k9Jd82mQpLx03VbnTT"), (6, "login=k9Jd82mQpLx03VbnTT, user=bob1")]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == got[2] == got[3] == got[4] == ""
    assert got[5] == "identifier:0:24,token:29:47"
    assert got[6] == "token:6:24,identifier:26:35"
    plain = spark.createDataFrame(rows[:4], "doc_id bigint, text string")
    assert {tuple(r) for r in secrets.redact(plain).collect()} == set(rows[:4])


def test_spans_against_every_pair(spark):
    """Random texts of parts: a weak part stands exactly if a complementary one lies near and apart."""
    rng = random.Random(3)
    parts = ["user=bob", "login: a1b2c3d4e5f6g7h8i9", "token=abcdef12", "AKIA" + "Q" * 16, "0a" * 12, "k9Jd82mQpLx03VbnTT",
             "https://h.example/x", "ssh://user=abcd:K3yK3yK3yK3yK3yK3y", " x" * 60, " - ", "account=" + "0a" * 13]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(1, 9)))) for i in range(400)]

    def want(text):
        found = []
        for rank, kind in enumerate(secrets.KINDS):
            for m in re.finditer(secrets.PATTERNS[kind], text):
                group, least = secrets.VALUE_GROUP.get(kind, (0, 0))
                if len(m.group(group)) >= least and (kind != "token" or re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])):
                    found.append((m.start(), rank, m.end()))
        out = []
        for s, r, e in found:
            near = {x for a, x, b in found if b <= s and b > s - secrets.REACH or a >= e and a < e + secrets.REACH}
            access, secret = bool(near & {1, 3}), bool(near & {0, 2, 4})
            covered = any(x < 3 and a < e and b > s for a, x, b in found)
            if r < 3 or not covered and {3: secret, 4: access, 5: access and secret}[r]:
                out.append((s, r, e))
        return ",".join(f"{secrets.KINDS[r]}:{s}:{e}" for s, r, e in sorted(out))

    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: want(t) for i, t in rows}


def test_redaction(spark, edge, empty):
    rows = [(1, 'é token = "' + "0a" * 12 + '" b AKIA' + "Z" * 16), (2, None), (3, "plain"), (4, "password=abcdef")]
    got = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 'é [SECRET]" b [SECRET]', 2: None, 3: "plain", 4: "[SECRET]"}
    assert secrets.redact(edge).count() == len(edge_rows()) and secrets.redact(edge).columns == edge.columns
    assert secrets.scan(empty).count() == 0 and secrets.redact(empty).count() == 0


# ---- 2 sharding ----

def test_sharding_law_and_slots(edge, empty, docs):
    tree = sharding.build_tree(40)
    grown = sharding.add_shard(tree)
    for df in (edge, docs):
        rows = sharding.shard_rows(df, "doc_id", "text", tree, grown).collect()
        texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        for _, g in itertools.groupby(sorted(rows, key=lambda r: r["shard"]), key=lambda r: r["shard"]):
            slots = sorted(r["slot"] for r in g)
            assert slots == list(range(len(slots)))
        assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)
        assert len({r["shard"] for r in rows if r["doc_id"] is None}) <= 1
    assert sharding.shard_rows(empty, "doc_id", "text", tree, grown).count() == 0


def test_sharding_weights(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("id"))
    tree = sharding.build_tree(12)
    heavy = sharding.set_weight(tree, 3, 4.0)
    lost = sharding.set_weight(tree, 3, 0.5)
    r = ids.select(*[sharding.shard_of(F.col("id"), t).alias(n) for n, t in (("a", tree), ("h", heavy), ("l", lost))]).toPandas()
    assert abs((r.h == 3).mean() - 4 / 15) < 0.02 and abs((r.a == 3).mean() - 1 / 12) < 0.02
    region, rack = {x.shard: x.region for x in tree}, {x.shard: x.rack for x in tree}
    moved = r[r.a != r.l]  # only out of the subtree whose weight fell
    assert len(moved) and set(moved.a.map(region)) == {region[3]}
    stay = moved[moved.l.map(rack) == rack[3]]
    assert set(stay.a) == {3}


# ---- 3 language ----

def test_language_accuracy_and_edges(docs, edge, empty):
    model = language.fit(docs)
    r = language.identify(docs.withColumn("held", language.held_out("doc_id")), model).toPandas()
    assert list(r.held) == [zlib.crc32(str(i).encode()) % 5 == 0 for i in r.doc_id]
    held = r[r.held & r.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.95 and r.score.between(0, 1).all()
    out = language.identify(edge, model)
    assert out.columns[:len(edge.columns)] == edge.columns and out.columns[-2:] == ["_lang_pred", "_score"]
    got = out.collect()
    assert len(got) == len(edge_rows())
    for x in got:
        letters = any(c.isalpha() for c in x["text"] or "")
        assert (x["_lang_pred"] == "und") == (not letters) and (letters or x["_score"] == 0)
    nothing = language.fit(empty)
    assert nothing.langs == [] and language.identify(edge, nothing).where("_lang_pred <> 'und'").count() == 0
    assert language.identify(empty, model).count() == 0


def test_language_counts_do_not_depend_on_chunks(monkeypatch):
    text = "Grüße, año 12 naïve déjà-vu " * 50
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "CHUNK", 7)
    assert (language.gram_counts(text) == whole).all()


# ---- 4 url filter ----

def _cascades(keys, listed):
    import pickle
    return [pickle.loads(r["cascade"]) for r in urlfilter.cascades(keys.withColumn("part", F.lit(0)), listed).collect()]


@pytest.mark.parametrize("sets", [500_000, 4_000, 700])
def test_cascades_are_exact(spark, monkeypatch, sets):
    """In one part or in many, with a key that holds a third of all rows."""
    monkeypatch.setattr(urlfilter, "PART_SETS", sets)
    keys = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("substr(key, 2) % 7 = 0")
    cascade, = _cascades(keys, listed.union(listed))
    assert len(cascade.levels) > 3
    rows = keys.union(spark.range(15_000).select(F.lit("k7").alias("key")))
    got = urlfilter.mark_listed(rows.union(spark.createDataFrame([(None,)], "key string")), "key", "hit", listed)
    assert got.where("hit <> coalesce(substr(key, 2) % 7 = 0, false)").count() == 0 and got.count() == 45_001
    none = spark.createDataFrame([], "key string")
    assert urlfilter.mark_listed(keys, "key", "hit", none).where("hit").count() == 0
    assert urlfilter.mark_listed(none, "key", "hit", listed).count() == 0


def test_rules_on_odd_urls(spark):
    from linkstream.llm.queries import RULES
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x?q#f"), (4, "http://example.org"), (5, "x://bad.net?/es/"),
            (6, "http://myexample.org/es/"), (7, "http://example.org/en/12"), (7, "http://example.org/en/12"), (None, "http://ÄB.com/fr/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("x")).withColumn("rule", F.lit("y"))
    listed = spark.createDataFrame([("bad.net",)], "host string")
    got = sorted((tuple(r) for r in urlfilter.judge(pages, RULES, listed).collect()), key=str)
    want = [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.org", "/es/x", "example.org/es/", "block"),
            (4, "example.org", "", None, "allow"), (5, "bad.net", "", None, "block"), (6, "myexample.org", "/es/", "org/", "allow"),
            (7, "example.org", "/en/12", "example.org/en/1", "block"), (7, "example.org", "/en/12", "example.org/en/1", "block"),
            (None, "Äb.com", "/fr/", "com/fr/", "allow")]
    assert got == sorted(want, key=str)


def test_key_list_decides(spark, monkeypatch):
    """Sites and hosts of the given list are blocked, whatever their names and the number of parts."""
    from linkstream.llm.queries import op4_url_filter
    hosts = ["www.badsite.net", "badsite.net", "badsite", "notbadsite.net", "badsite.x.net", "x.badsite", "spam-farm.net", "a.b.net", "b.net", ""]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id bigint, url string")
    listed = spark.createDataFrame([("badsite.",), ("b.net",), (None,)], "host string")
    want = {"www.badsite.net", "badsite.net", "badsite.x.net", "b.net"}
    for sets in (urlfilter.PART_SETS, 1):
        monkeypatch.setattr(urlfilter, "PART_SETS", sets)
        got = urlfilter.judge(pages, [], listed).collect()
        assert {r["host"] for r in got if r["verdict"] == "block"} == want and len(got) == len(hosts)
    got = op4_url_filter(spark, SF001, ["example"]).collect()
    assert {r["verdict"] for r in got if r["rule"] is None} == {"block"}


# ---- 5 html ----

def test_pages_equal_their_articles(spark):
    pages = read_table(spark, SF001, "pages")
    got = {r["page_id"]: r for r in wrappers.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(_html.unescape(re.sub("</?b>|<br>", "", b)).split()) for b in re.split("</?p>|</?h1>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_pages_without_article_and_odd_markup(spark):
    def page(i):
        return (f"<body><header><h2>Site</h2></header><div class='menu'><a href=x>One</a></div><div id=content><p>Text {i} &amp; more"
                f"<p>b{i}<script>if (a<b) x('<p>no</p>')</script></div><div class='cookie-notice'>We use {i}</div>"
                f"<div><p>Always the same</p></div><section class=comments><p>I say {i}</p></section><form><p>Mail {i}</p></form>")
    rows = [(i, "http://h.net/x", page(i)) for i in range(5)]
    rows += [(9, None, None), (10, "http://z.net", "<p>a<b>b</b> c&nbsp;d &#233; <!-- x"), (11, "http://z.net", "<"), (11, "http://z.net", "<")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("main", F.lit(2))
    got = sorted((r["page_id"], r["text"]) for r in wrappers.extract(df).collect())
    assert got == sorted([(i, f"Text {i} & more\nb{i}") for i in range(5)] + [(9, ""), (10, "ab c d é"), (11, "<"), (11, "<")])
    assert wrappers.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><body><article><p>Text</article>",
    "<html><head><meta charset=x><title>T <b></title><noscript><img src=x></noscript><article><p>Text</article>",
    "<head><title>T</title></head><article><script>for(i=0;i<n;i++){} // don't</script><p>Text</article>",
    "<article><script>var a='<!-- <p>no</p>';</script><p>Text</p></article>",
    "<article><style>a::after{content:'<p'}</style><p>Text</article><script>it's",
    "<article><form><select><option>One<option>Two</form><p>Text</article>",
    "<article><div><textarea>mail</div><p>Text</article>",
    "<article><svg><path d=x><text>no</text><p>Text</article>",
    "<article><svg><svg><text>no</text></svg><text>no</text></svg><p>Text</article>",
    "<article><video src=x><p>Text</article>",
    "<article><template><p>no<template>no</template></p><p>no</template><p>Text</article>",
])
def test_skipped_elements_end(page):
    got = [t for slot, t, _ in wrappers.blocks(page) if "article" in slot and not slot.endswith("form")]
    assert got == ["Text"]


def test_words_exclude_whole_names_that_leave_text(spark):
    rows = [(1, "http://a.net", "<body class='has-sidebar'><p>Text</p><div class='main-sidebar'><p>no</p></div>"),
            (2, "http://b.net", "<div id='content-with-sidebar'><p>Text</p></div><p class='share'>no"),
            (3, "http://c.net", "<article class='post comments-open'><p>Text</p><div class='comments'><p>no</p></div></article>"),
            (4, "http://d.net", "<main class='sidebar no-header'><p>Text</main><aside><p>no</aside>"),
            (5, "http://e.net", "<div class='sidebar'><p>Text</p></div><nav><p>no</nav>"),
            (6, "http://f.net", "<div class='widget'><article><p>Text</article></div>")]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(i, "Text") for i in range(1, 7)]


def test_fixed_text_between_content_of_its_name(spark):
    """A constant paragraph in a slot of the same name as the text's is template."""
    def page(i):
        return (f"<div><p>Subscribe now</p></div><div><p>Text {i}</p>" + "".join(f"<p>more {i} {j}" for j in range(i % 4))
                + "</div><div><p>Follow us</p></div><div><p>Last " + str(i) + "</div>")
    rows = [(i, "http://h.net/x", page(i)) for i in range(9)] + [(20, "http://h.net/x", ""), (21, "http://two.net", page(1)), (22, "http://two.net", page(2))]
    # what a mark as article holds is kept whole, and texts of some pages are no template
    rows += [(30 + i, "http://i.net", f"<article><p>Same<p>Text {i}</article>") for i in range(4)]
    rows += [(40 + i, "http://j.net", f"<div><p>{'Quoted' if i < 4 else i}<p>Text {i}</div>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    for i in range(9):
        assert got[i] == "\n".join([f"Text {i}", *(f"more {i} {j}" for j in range(i % 4)), f"Last {i}"])
    assert got[20] == "" and got[21].startswith("Subscribe now\nText 1")
    assert all(got[30 + i] == f"Same\nText {i}" for i in range(4))
    assert all(got[40 + i] == f"{'Quoted' if i < 4 else i}\nText {i}" for i in range(5))


def _page_in_article(i):
    """An article whose junk is told by the wrapper, by nesting or by links: no name says it."""
    return (f"<body><article class='x{i}f'><header><h1>Title {i}</h1></header><div class='q{i}a'><p>Tell a friend</p><p>Print this</p></div>"
            f"<div class='b{i}'><p>Text {i}</p><p>Always said</p><p>More {i}</p></div><div class='z9'><p>Follow the author</p></div>"
            f"<ul class=k{i}><li><a href=a>Other story {i}</a><li><a href=b>Next story {i * 7}</a></ul>"
            f"<article class='comment'><p>I think {i}</p></article></article>")


def test_junk_inside_articles_that_only_the_wrapper_tells(spark):
    rows = [(i, "http://k.net/x", _page_in_article(i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert got == {i: f"Title {i}\nText {i}\nAlways said\nMore {i}" for i in range(6)}


def test_alignment_decides(monkeypatch):
    """Without alignment no position is known to be fixed, and the template stays."""
    def texts():
        made = [wrappers.page_wrapper(wrappers.blocks(_page_in_article(i))) for i in range(6)]
        whole = made[0]
        for w in made[1:]:
            whole = wrappers.merge(whole, w)
        main = wrappers._judged(whole)
        return [wrappers.page_text(_page_in_article(i), main) for i in range(6)]
    assert all("Tell a friend" not in t and "Follow the author" not in t for t in texts())
    monkeypatch.setattr(wrappers, "align", lambda a, b: [])
    assert all("Tell a friend" in t and "Follow the author" in t for t in texts())


@pytest.mark.parametrize("name", ["class='share-buttons'", "class='cookie-law-bar'", "class='promo_teaser'", "class='related-news'",
                                  "id=disqus_thread", "class='col user-comments x7'", "class=newsletter-signup-box"])
def test_names_of_junk_inside_articles(name):
    page = f"<article><header><h1>T</h1></header><p>Text</p><div {name}><p>no</p></div></article>"
    assert wrappers.page_text(page, wrappers._judged(wrappers.page_wrapper(wrappers.blocks(page)))) == "T\nText"
    for keep in ("<article class='post comments-open'>", "<article class='share-enabled'>", "<div class='comments-closed'>"):
        page = f"{keep}<p>Text</p>"
        assert wrappers.page_text(page, wrappers._judged(wrappers.page_wrapper(wrappers.blocks(page)))) == "Text"


def test_names_and_groups_have_no_caps():
    a, b = (wrappers.blocks(f"<div class='a b c d {x}'><p>t</div>")[0][0] for x in ("e", "zz"))
    assert a != b
    assert wrappers.blocks("<div class='css-1x2y item-77'><p>t</div>")[0][0] == "div.css.item>p"
    items = wrappers.page_wrapper([(x, x, 0) for x in "h" + "abcdefghij" * 3 + "z"])[0]
    assert [x[1] for x in items] == [False, True, False] and [y[0] for y in items[1][0]] == list("abcdefghij")


def test_wrapper_alignment():
    def w(slots):
        return wrappers.page_wrapper([(s, s, 0) for s in slots])
    a = wrappers.merge(w("nppppf"), w("npqpqpqf"))
    assert [[x[0] if isinstance(x[0], str) else [y[0] for y in x[0]], x[1], x[2]] for x in w("npqpqpqf")[0]] == [
        ["n", False, False], [["p", "q"], True, False], ["f", False, False]]
    assert a[0][0] == ["n", False, False] and a[0][-1] == ["f", False, False] and all(x[2] for x in a[0][1:-1])
    assert a[1]["n"][0] == 2 and a[1]["n"][3] is not None and a[1]["p"][3] is None


# ---- 6 mixing ----

def test_mixing_reaches_target_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"),
                                    F.lit("x" * 10).alias("text"))
    got = mixing.mix(df, weights={"a": 3.0, "b": 1.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["a"] / 15_000 - 1) < 0.03 and abs(n["b"] / 5_000 - 1) < 0.05
    big = mixing.mix(df.where("doc_id < 40"), weights={"a": 1.0}, budget=100.0).groupBy("doc_id").count().toPandas()
    assert len(big) == 10 and abs(big["count"].mean() - 400) < 30  # means above MAX_MEAN


def test_mixing_edges(edge, empty):
    got = mixing.mix(edge)
    assert got.columns[:len(edge.columns)] == edge.columns and got.columns[-4:] == ["_copy", "_copies", "_rate", "shuffle_key"]
    rows = got.collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(edge.repartition(3)).collect()))
    for r in rows:
        assert 0 <= r["_copy"] < r["_copies"]
    assert mixing.mix(empty).count() == 0


# ---- 7 packing ----

def test_packing_round_trip(docs, edge, empty):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.tokenizer_path())
    for df in (docs, edge):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
            for s in range(0, len(ids), 4096):
                want[r["doc_id"], s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes()), len(ids)] += 1
        rows = packing.pack(df).collect()
        assert Counter(tuple(r)[:5] for r in rows) == want
        used = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert used.get(r["sequence_id"], 0) == r["offset"]
            used[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(used.values()) <= 4096 and sorted(used) == list(range(len(used)))
    assert packing.pack(empty).count() == 0
    small = packing.packed_ids(edge, packing.pack(edge))
    assert small.count() == sum(want.values())


def test_patterns_hold_the_histogram():
    rng = np.random.default_rng(3)
    for h in ({1000: 100}, {1: 9000}, {4096: 3, 1: 1}, {int(k): int(v) for k, v in zip(rng.integers(1, 4097, 300), rng.integers(1, 50, 300))}):
        found = packing.patterns(h)
        back = Counter()
        for packs, lengths in found:
            assert sum(length * times for length, times in lengths) <= 4096
            for length, times in lengths:
                back[length] += packs * times
        assert back == Counter(h)
        total, packs = sum(k * v for k, v in h.items()), sum(p for p, _ in found)
        assert packs <= total / 4096 * 1.1 + 2


def test_word_ids_equal_the_tokenizer_on_random_strings():
    """Dotted capitals, combining marks, odd white space, marks behind all of them."""
    w = packing.WordIds(packing.tokenizer_path())
    rng = random.Random(11)
    alphabet = ["İ", "I", "ı", "ß", "É", "e\u0301", "\u0307", "\u0308", "ö", "Σ", "ς", "ſ", "ﬁ", "Ǆ", "日", "😀", "١", "²", "a", "B", "z", "7", ".", ",", "!",
                "#", "*", ")", "(", "'", "-", "_", "\n", " ", "\t", "\u00a0", "\u2009", "\u200b", "\u0000", "\r\n", "Ω", "K"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 9))) for _ in range(100_000)]
    texts += ["İSTANBUL BÜYÜKŞEHİR BELEDİYESİ. YENİ", "Aİ.", "İ!", "aİ)", "x̂."]
    wrong = [t for t, e in zip(texts, w.tokenizer.encode_batch(texts, add_special_tokens=False)) if list(np.frombuffer(w.text(t), "<u4")) != e.ids]
    assert not wrong, wrong[:10]


def test_word_ids_equal_the_tokenizer():
    w = packing.WordIds(packing.tokenizer_path())
    for x in ["it's, O'Neil's!! a),b ...x y', z'' don't. I'M. <|endoftext|> <|endoftext|>,", "Σας ΣΑΣ, İx, é, É. x́, 12. 1,2,. ,,, (a) \ttab\tx,\tb. \x1c x\x1c, ½, ².",
              "ÀÉÎ straße, GRÖSSE. ñandú! \u00a0nb \u3000 漢字。😀! ª º µ, ×÷ ÿ"]:
        assert list(np.frombuffer(w.text(x), "<u4")) == w.tokenizer.encode(x, add_special_tokens=False).ids


# ---- 8 near duplicates ----

def brute_links(rows):
    def sh(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if x]
        return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    sets = [sh(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
            links[i] += 1
            links[j] += 1
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str)


def test_near_duplicates_edges(edge, empty):
    got = sorted((tuple(r) for r in neardup.join(edge).select("doc_id", "class_id", "n_links").collect()), key=str)
    assert got == brute_links([(r[0], r[1]) for r in edge_rows()])
    one = neardup.deduplicate(edge)
    classes = {str(r[1]) for r in got}
    assert one.columns == edge.columns and one.count() == len(classes)
    assert neardup.join(empty).count() == 0 and neardup.deduplicate(empty).count() == 0


def test_large_group_in_blocks(spark, monkeypatch):
    """Many different near copies: all links counted, over several blocks and pivots."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for d in range(150):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((d, " ".join(words)))
    rows += [(200 + i, " ".join(f"u{rng.integers(10**6)}" for _ in range(40))) for i in range(20)]
    got = sorted((tuple(r) for r in neardup.join(spark.createDataFrame(rows, "doc_id bigint, text string"))
                  .select("doc_id", "class_id", "n_links").collect()), key=str)
    assert got == brute_links(rows)


def test_blocks_without_a_member(spark, monkeypatch):
    """Few long near copies cut by bytes: some of a group's blocks stay empty."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 256)
    rows = [(8 * g + i, " ".join([f"g{g}w{j}" for j in range(200)] + [f"end{i}"])) for g in range(6) for i in range(3)]
    got = sorted((tuple(r) for r in neardup.join(spark.createDataFrame(rows, "doc_id bigint, text string"))
                  .select("doc_id", "class_id", "n_links").collect()), key=str)
    assert got == brute_links(rows)


def test_components_of_a_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(
        spark.createDataFrame([(1000, 1001), (1002, 1001)], "a bigint, b bigint"))
    got = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in (1000, 1001, 1002)}}


# ---- 9 top k ----

def brute_topk(rows, is_query, k=5):
    seen = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            seen[i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)] = None
    out = []
    for i, q in seen:
        if is_query(i):
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in seen if j != i and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "INDEX_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SLICE", 2)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 16).astype("f4")]) for i in range(300)]
    rows += [(400 + i, rows[50][1]) for i in range(8)] + [rows[7], (500, None), (550, [1.0, None]), (600, [float("nan")] * 16), (None, rows[1][1]),
                                                          (650, [0.5, 0.5]), (700, [float("inf")] * 16), (750, []), (800, [0.0] * 16), (901, [0.5, -0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0).collect())
    assert got == brute_topk(rows, lambda i: i % 50 == 0)
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0


# ---- 10 quality ----

def brute_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    marked = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n, rep = len(words), len(marked)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 50 or 100 * rep > 50 * n


def test_quality_counts_and_verdicts(spark, docs, edge, empty):
    labels = read_table(spark, SF001, "labels")
    odd = spark.createDataFrame([(1, "a\x85b\xa0c \x1cd \x0be\x0cf\r\n\r\n \na a a a a\nx\nx \nx"), (2, "a b c a b c"), (3, "\ud7ff é# <b>")], "doc_id bigint, text string")
    for df in (docs, edge, odd):
        got = quality.judge(df, labels).collect()
        want = sorted(((r["doc_id"], *brute_counts(r["text"])) for r in df.select("doc_id", "text").collect()), key=str)
        assert sorted((tuple(r)[:7] for r in got), key=str) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.judge(empty, labels).count() == 0
    free = quality.judge(docs, labels.limit(0)).collect()  # without labels only the base rules act
    assert all(r["kept"] != r["base_failed"] for r in free)


def test_quality_keeps_clean_drops_junk(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    r = quality.judge(docs, labels).join(labels, "doc_id").where("not base_failed").toPandas()
    assert r[(r.quality == 1) & (r.toxic == 0)].kept.mean() > 0.99 and r[r.quality == 0].kept.mean() < 0.1


def test_threshold():
    assert quality.threshold([]) == quality.threshold([(1, 5, 0)]) == float("-inf")
    assert quality.threshold([(-5, 0, 3), (2, 10, 0)]) == -4 / quality.STEPS
