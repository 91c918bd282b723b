"""The registered queries of the corpus operators and their DuckDB SQL.

Each query applies its operator, with production parameters, to the whole
table and returns the full result.  Operators that SQL cannot express
(trained models, trees of hash draws over crc32, tokenizers, HTML) have no
SQL here and are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from linkstream.llm import infill, language, lexical, mixing, neardup, packing, quality, secrets, sharding, topk, toxicity, urlfilter, wrappers
from linkstream.llm.common import documents
from linkstream.sources.tables import read_table

SHARDS = 40

# The rules of the pages query, and the listed sites (the pattern is for the SQL).
RULES = (
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
)
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_PATTERN = r"(^|[.])(" + "|".join(LISTED_SITES) + r")[.]"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.build_tree(SHARDS)
    return sharding.shard_rows(documents(spark, sf_dir), "doc_id", "text", tree, sharding.add_shard(tree))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs)
    found = language.identify(docs.select("doc_id", language.held_out("doc_id").alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def listed_keys(spark: SparkSession, sf_dir: str, sites: Sequence[str]) -> DataFrame:
    """The key list: ``sites`` as labels, and the url (host and path) of every
    page whose number ``labels`` marks as toxic."""
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    flagged = pages.join(labels.where("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct(), "page_id")
    url = F.concat(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))).alias("host")
    return spark.createDataFrame([(site + ".",) for site in sites], "host string").unionByName(flagged.select(url))


def op4_url_filter(spark: SparkSession, sf_dir: str, sites: Sequence[str] = LISTED_SITES) -> DataFrame:
    return urlfilter.judge(read_table(spark, sf_dir, "pages"), RULES, listed_keys(spark, sf_dir, sites))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read_table(spark, sf_dir, "pages"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), keep=["doc_id", "source"])


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(documents(spark, sf_dir))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "text")
    return toxicity.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.transform(documents(spark, sf_dir)))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_sharding, op3_language_id, op4_url_filter, op5_html_extraction,
                            op6_source_mixing, op7_packing, op8_ngram_jaccard_join, op9_exact_topk, op10_quality_rules,
                            op11_toxicity, op12_infill, op13_lexical_search)
} | {"pipeline": corpus_pipeline.run}


# ---- SQL ---------------------------------------------------------------------

def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SQL_PATTERNS = {
    "assign": "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
              + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "identifier": "(" + "|".join(map(_either_case, ("username", "user", "login", "account", "client_id")))
                  + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.@=-]+)""",
    "token": r"[A-Za-z0-9+/_-]{16,}",
    "endpoint": r"(https|http|ftp|ssh|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?@%&=+-]+",
}
_SQL_OK = {"assign": "length(regexp_extract(m, p, 2)) >= 6", "identifier": "length(regexp_extract(m, p, 2)) >= 3",
           "token": "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')"}


def _sql_kind(rank: int, kind: str) -> str:
    return (f"select t, {rank} as rk, '{kind}' as kind, '{_SQL_PATTERNS[kind]}' as p, regexp_extract_all(t, '{_SQL_PATTERNS[kind]}') as ms, "
            f"string_split_regex(t, '{_SQL_PATTERNS[kind]}') as ps from texts where regexp_matches(t, '{_SQL_PATTERNS[kind]}')")


#: b does not overlap a, and lies within reach of it.
_SQL_NEAR = f"(b.e <= a.s and b.e > a.s - {secrets.REACH} or b.s >= a.e and b.s < a.e + {secrets.REACH})"
_SQL_OP1 = f"""
with texts as (select distinct coalesce(text, '') as t from documents),
found as ({' union all '.join(_sql_kind(i, k) for i, k in enumerate(secrets.KINDS))}),
each as (select t, rk, kind, p, ms, ps, unnest(range(1, len(ms) + 1)) as i from found),
parts as (
  select t, rk, kind, s, s + length(m) as e from (
    select t, rk, kind, p, ms[i] as m,
           cast(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as bigint) as s
    from each)
  where case kind {' '.join(f"when '{k}' then {v}" for k, v in _SQL_OK.items())} else true end),
near as (
  select a.t, a.rk, a.kind, a.s, a.e,
    coalesce(bool_or(b.rk < 3 and b.e > a.s and b.s < a.e), false) as covered,
    coalesce(bool_or(b.rk in (1, 3) and {_SQL_NEAR}), false) as acc,
    coalesce(bool_or(b.rk in (0, 2, 4) and {_SQL_NEAR}), false) as sec
  from parts a left join parts b on a.t = b.t and (a.rk, a.s) <> (b.rk, b.s)
  group by all),
kept as (select * from near where case when rk < 3 then true when covered then false when rk = 3 then sec when rk = 4 then acc else acc and sec end),
per as (
  select t, count(*) filter (where rk = 0) as n_assign, count(*) filter (where rk = 1) as n_access, count(*) filter (where rk = 2) as n_hex,
    string_agg(concat(kind, ':', s, ':', e), ',' order by s, rk) as spans,
    string_agg(concat(kind, ':', s, ':', e), ',' order by s, rk) filter (where rk < 3) as base,
    count(*) filter (where rk >= 3) as n_linked
  from kept group by t)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_linked, 0) as n_linked
from documents d left join per on per.t = coalesce(d.text, '')
"""


def _sql_rules(field: str) -> str:
    longest_first = sorted(RULES, key=lambda r: -len(r.name))
    return "case " + " ".join(
        f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{getattr(r, field)}'"
        for r in longest_first) + " end"


_SQL_OP4 = rf"""
with cut as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut),
flagged as (select distinct host || path as key from parts where page_id in (select doc_id from labels where toxic = 1))
select page_id, host, path, {_sql_rules('name')} as rule,
  coalesce({_sql_rules('verdict')}, case when regexp_matches(host, '{LISTED_PATTERN}') or host || path in (select key from flagged)
    then 'block' else 'allow' end) as verdict
from parts
"""

_SQL_OP6 = """
with d as (select doc_id, source, text, coalesce(cast(doc_id as varchar), 'text:' || md5(coalesce(text, ''))) as k from documents),
sizes as (select source, cast(coalesce(sum(length(text)), 0) as bigint) as chars from d group by source),
w as (select source, chars, case when chars > 0 then sqrt(cast(chars as double)) else 0 end as w from sizes),
rates as (select source, case when chars > 0 then round(w / (select sum(w) from w) * (select sum(chars) from w) / chars, 12) else 1 end as rate from w),
means as (select *, greatest(ceil(rate / 32), 1) as parts, rate / greatest(ceil(rate / 32), 1) as mean from rates),
cdf as (
  select source, round(sum(case when mean = 0 then case when k = 0 then 1 else 0 end else exp(-mean + k * ln(mean) - lgamma(k + 1)) end)
    over (partition by source order by k), 12) as c
  from means, range(0, 140) r(k) where k <= cast(floor(mean + 12 * sqrt(mean) + 30) as bigint)),
draws as (
  select doc_id, d.source, k, rate, j, (cast('0x' || substr(md5('0|' || k || '|' || j), 1, 13) as bigint) + 0.5) / 4503599627370496.0 as u
  from (select distinct doc_id, source, k from d) d join means m on d.source is not distinct from m.source,
    range(1, 1000) p(j) where j <= parts),
drawn as (
  select g.doc_id, g.source, g.k, g.rate, g.j, count(c.c) as n
  from draws g left join cdf c on g.source is not distinct from c.source and c.c <= g.u group by all),
counts as (select doc_id, source, k, rate, cast(sum(n) as bigint) as copies from drawn group by all),
rows as (select d.doc_id, d.source, d.k, c.rate, c.copies from d join counts c on d.k = c.k and d.source is not distinct from c.source),
each as (select *, unnest(range(0, copies)) as copy from rows)
select doc_id, source, cast(copy as bigint) as copy, copies, rate,
  cast('0x' || substr(md5('0:shuffle|' || k || '|' || copy), 1, 15) as bigint) as shuffle_key
from each
"""

_SQL_OP8 = r"""
with recursive normal as (
  select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as t from documents),
class as (select t, min(doc_id) as rep, count(*) as n, row_number() over (order by t) as c from normal group by t),
sh as (
  select distinct c, unnest(case when t = '' then [] when len(w) < 5 then [t]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s
  from (select c, t, string_split(t, ' ') as w from class)),
size as (select c, count(*) as n from sh group by c),
shared as (select a.c as a, b.c as b, count(*) as n from sh a join sh b on a.s = b.s and a.c < b.c group by all),
half as (select a, b from shared join size x on x.c = a join size y on y.c = b where 5 * shared.n >= 4 * (x.n + y.n - shared.n)),
link as (select a, b from half union all select b, a from half),
reach as (select c as a, c as b from class union select r.a, l.b from reach r join link l on r.b = l.a),
root as (select r.a as c, min(class.rep) as class_id from reach r join class on class.c = r.b group by r.a),
degree as (select a as c, count(*) as texts, sum(class.n) as docs from link join class on class.c = b group by a)
select normal.doc_id, class_id, rep as copy_id, cast(coalesce(docs, 0) + class.n - 1 as bigint) as n_links,
  cast(coalesce(texts, 0) as bigint) as n_text_links
from normal join class on class.t = normal.t join root on root.c = class.c left join degree on degree.c = class.c
"""

_SQL_OP9 = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""

_SQL_OP12 = """
with hashed as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
tokens as (
  select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as w, cast('0x' || substr(h, 1, 8) as bigint) as h1,
    cast('0x' || substr(h, 9, 8) as bigint) as h2, cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
  from hashed),
cuts as (
  select *, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as lo, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as hi,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from tokens),
parts as (
  select doc_id, t, len(w) as n, form, coalesce(array_to_string(w[1:lo], ''), '') as p,
    coalesce(array_to_string(w[lo + 1:hi], ''), '') as m, coalesce(array_to_string(w[hi + 1:], ''), '') as s
  from cuts)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""

_SQL_OP13 = r"""
with terms as (
  select doc_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from documents),
tfs as (select doc_id, t, count(*) as tf from terms group by all),
docs as (select doc_id, cast(sum(tf) as bigint) as n from tfs group by all),
stats as (select count(*) as nn, cast(sum(n) as bigint) as ll from docs),
weights as (select t, cast(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) as bigint) as w from tfs, stats group by t, nn),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from benchmark),
scored as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * nn) // ll))))) as bigint) as score
  from asked join tfs using (t) join weights using (t) join docs using (doc_id), stats group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50
"""

ORACLES: dict[str, str] = {
    "op1_secret_scan": _SQL_OP1,
    "op4_url_filter": _SQL_OP4,
    "op6_source_mixing": _SQL_OP6,
    "op8_ngram_jaccard_join": _SQL_OP8,
    "op9_exact_topk": _SQL_OP9,
    "op12_infill": _SQL_OP12,
    "op13_lexical_search": _SQL_OP13,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
