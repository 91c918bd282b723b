"""Secret scans by multipart credential linking (native).

Three base patterns (assigned secrets, access identifiers, long hex runs) are
always reported.  Three weak patterns are candidates only: an account
identifier, a mixed-character token and an endpoint prove nothing alone.  All
parts of a text become intervals, and an interval join finds for each weak
part whether a complementary part of the same scope (the text), which does not
overlap it, lies within ``REACH`` code points:

* identifier: a secret part (assign, hex, or a candidate token);
* token: an access part (access, or a candidate identifier);
* endpoint: both an access part and a secret part.

The interval join is a sweep over the starts and ends of all parts of a text:
the last end of each role before a part's start, and the first start after its
end, are its nearest ones, so no pair is ever formed.  Weak parts that overlap
a base part (more base parts started before its end than ended by its start)
add nothing and go.

Positions are counted in code points.  Pattern matches carry no positions in
SQL, so each text is also split by its pattern: a match starts where the
pieces and matches before it end, a running sum over the exploded matches.
Each text is matched once; only texts with a match are exploded, and each
distinct one once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkstream.llm.common import free_name, written

#: Largest gap in code points between parts of one credential.
REACH = 200

# Kinds in report order, their patterns, and the shortest match.
BASE = ("assign", "access", "hex")
KINDS = ("assign", "access", "hex", "identifier", "token", "endpoint")
# Lookarounds: a match can begin only at those letters, or where a run begins, which spares most tries; a token
# is a whole run that holds letters and digits.
PATTERNS = {
    "assign": r"""(?=[PpSsTtAa])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "identifier": r"""(?=[UuLlAaCc])(?i:(username|user|login|account|client_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""",
    "token": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}",
    "endpoint": r"""(?=[hfsjpmra])(https|http|ftp|ssh|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?@%&=+-]+""",
}
#: Of assign and identifier, the least length of the value.
VALUE_GROUP = {"assign": (2, 6), "identifier": (2, 3)}
#: Reported in place of a secret by ``redact``.
MARK = "[SECRET]"


def _matches(text: Column, kind: str) -> Column:
    """array<struct<gap, len, ok>>: code points since the match before, code
    points of the match, and whether it stands."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    if kind in VALUE_GROUP:
        group, least = VALUE_GROUP[kind]
        oks = F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), lambda v: F.length(v) >= least)
    else:
        oks = F.transform(found, lambda m: F.lit(True))
    all_ = F.transform(found, lambda m, i: F.struct(
        F.get(gaps, i).alias("gap"), F.length(m).alias("len"), F.get(oks, i).alias("ok")))
    return F.when(text.rlike(PATTERNS[kind]), all_)


def _parts(text: Column) -> Column:
    """All kinds' matches, or null for a text with no match at all."""
    arrays = [_matches(text, k) for k in KINDS]
    return F.array(*arrays)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def text_spans(texts: DataFrame, reach: int = REACH) -> DataFrame:
    """(k, parts) of distinct texts -> (k, spans): array of (start, rank, end)
    in order, with rank the place in KINDS; texts without spans are left out."""
    by_kind = texts.select("k", F.posexplode("parts").alias("rank", "found")).where(F.size("found") > 0)
    at = by_kind.select("k", "rank", F.posexplode("found").alias("i", "m"))
    so_far = Window.partitionBy("k", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    parts = (at.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(so_far).cast("bigint"))
               .where(F.col("m.ok"))
               .select("k", "rank", (F.col("end") - F.col("m.len")).alias("start"), "end"))

    base, access, secret = F.col("rank") < 3, F.col("rank").isin(1, 3), F.col("rank").isin(0, 2, 4)
    events = parts.withColumn("is_start", F.explode(F.array(F.lit(True), F.lit(False)))) \
                  .withColumn("at", F.when(F.col("is_start"), F.col("start")).otherwise(F.col("end")))
    is_start, is_end = F.col("is_start"), ~F.col("is_start")
    # At one place ends come before starts, both ways round: parts that touch do not overlap.
    ahead = Window.partitionBy("k").orderBy("at", "is_start").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("k").orderBy(F.col("at").desc(), F.col("is_start").desc()).rowsBetween(Window.unboundedPreceding, 0)

    def near(role: Column) -> Column:
        before = F.max(F.when(role & is_end, F.col("at"))).over(ahead) > F.col("start") - reach
        after = F.min(F.when(role & is_start, F.col("at"))).over(back) < F.col("end") + reach
        return F.coalesce(F.when(is_start, before).otherwise(after), F.lit(False))

    seen = events.select("*", near(access).alias("by_access"), near(secret).alias("by_secret"),
                         F.count(F.when(base & is_start, True)).over(ahead).alias("started"),
                         F.count(F.when(base & is_end, True)).over(ahead).alias("ended"))
    seen = seen.groupBy("k", "rank", "start", "end").agg(
        F.max("by_access").alias("by_access"), F.max("by_secret").alias("by_secret"),
        (F.max(F.when(is_end, F.col("started"))) > F.max(F.when(is_start, F.col("ended")))).alias("covered"))
    linked = (F.when(base, True).when(F.col("covered"), False)
               .when(F.col("rank") == 3, F.col("by_secret")).when(F.col("rank") == 4, F.col("by_access"))
               .otherwise(F.col("by_access") & F.col("by_secret")))
    return seen.where(linked).groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("start", F.col("rank").cast("int").alias("rank"), "end"))).alias("spans"))


def _listing(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))


def _count(spans: Column, rank: int) -> Column:
    return F.coalesce(F.size(F.filter(spans, lambda s: s["rank"] == rank)), F.lit(0)).cast("bigint")


def _found(text: Column) -> Column:
    """The parts of a text, null without any match."""
    any_match = F.coalesce(*[F.when(text.rlike(PATTERNS[k]), True) for k in KINDS], F.lit(False))
    return F.when(any_match, _parts(text))


def _spans(hits: DataFrame, reach: int) -> DataFrame:
    """(k, parts) of rows -> (k, spans) of their distinct texts, as a table."""
    return written(text_spans(hits.groupBy("k").agg(F.first("parts").alias("parts")), reach))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """-> (id, n_assign, n_access, n_hex, base_sha256, spans, n_linked), a row per row.

    A null text is an empty one; an empty text has no spans (``spans`` empty,
    the hash that of no bytes).  Rows that share an id or a text are each
    answered; spans are a function of the text alone.  Overlapping kinds are
    all reported; within a kind matches are leftmost and do not overlap.
    Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(df.select(F.col(id_col).alias("id"), _found(text).alias("parts"), text_key(text).alias("_k")))
    hits = rows.where(F.col("parts").isNotNull())
    spans = _spans(hits.select(F.col("_k").alias("k"), "parts"), reach)
    res = hits.select("id", "_k").join(spans, F.col("_k") == F.col("k"), "left").select("id", "spans")
    res = res.unionByName(rows.where(F.col("parts").isNull()).select("id", F.lit(None).cast(res.schema["spans"].dataType).alias("spans")))
    s = F.col("spans")
    base = F.filter(s, lambda x: x["rank"] < 3)
    return res.select(F.col("id").alias(id_col), _count(s, 0).alias("n_assign"), _count(s, 1).alias("n_access"),
                      _count(s, 2).alias("n_hex"), F.sha2(_listing(base), 256).alias("base_sha256"),
                      _listing(s).alias("spans"),
                      F.coalesce(F.size(F.filter(s, lambda x: x["rank"] >= 3)), F.lit(0)).cast("bigint").alias("n_linked"))


def redact(df: DataFrame, text_col: str = "text", reach: int = REACH, mark: str = MARK) -> DataFrame:
    """The rows of ``df`` with every span of the scan replaced by ``mark``;
    overlapping spans become one.  Texts without spans, null and empty ones
    included, stay as they are; no row goes."""
    key, match, found, out, hit = free_name(df, "k", "span_key", "spans", "parts", "hit")
    text = F.col(text_col)
    rows = df.withColumn(out, _found(text)).withColumn(hit, F.col(out).isNotNull().cast("int"))
    rows = written(rows.withColumn(key, F.when(F.col(hit) == 1, text_key(text))), hit)
    hits, others = rows.where(F.col(hit) == 1), rows.where(F.col(hit) == 0)
    spans = _spans(hits.select(F.col(key).alias("k"), F.col(out).alias("parts")), reach).select(
        F.col("k").alias(match), F.col("spans").alias(found))
    # Covered pieces: from the largest end so far (or the span's end) on, up to the next start.
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(text.substr(acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark))) \
                 .otherwise(F.lit(""))
        # a span that overlaps the one before belongs to its mark
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["done"], piece).alias("done"))

    def finish(acc):
        return F.concat(acc["done"], text.substr(acc["at"].cast("int") + 1, F.length(text)))

    new = F.when(F.col(found).isNull(), text).otherwise(F.aggregate(F.col(found), start, step, finish))
    changed = hits.join(spans, F.col(key) == F.col(match), "left").withColumn(text_col, new)
    return others.select(*df.columns).unionByName(changed.select(*df.columns))
