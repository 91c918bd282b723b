"""Link table: mutations under ownership rules, snapshots, history.

``apply_mutations`` replays insert / update / delete in (commit_ts, seq)
order per id with the original guards:

* insert succeeds iff the id is absent (primary key);
* update / delete succeed iff the id is present and the caller's user id
  is non-null and equals the owner; update changes only ``long_url``
  (``created_at`` is kept), delete removes the row.

A sequential fold per key would put a hot key into one task.  Instead the
fold is decomposed into *lives*: a life starts at a successful insert and
ends at the first later delete by its owner; the next life starts at the
first insert after that delete.  "Next delete by owner" and "next insert"
are ordered scans (``plans.scan``), which cut every id into ranges of rows;
which inserts start a life is found by pointer doubling over
``succ(insert) = next_insert(next_delete)`` from the first insert of each
id - ``log2(lives)`` rounds of equi-joins on unique event positions, with
the lineage cut each round.  Every other verdict is then a per-row
expression.

An event's position is its number in the order (id, time, seq, op, user,
URL), so two events of one id with equal (commit_ts, seq) have one order
and one insert of them wins; events equal in all of it are interchangeable.
The scans and the doubling carry no URL; it joins back once at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkstream.constants import REASON_UNAUTHORIZED, STALE_READ
from linkstream.functions.text import blank, display_count, display_date
from linkstream.functions.timefns import ts_literal
from linkstream.plans.joins import BUCKET_COL, join_links
from linkstream.plans.ranking import global_row_number, stable
from linkstream.plans.scan import PART, POS, ordered, scan_last

# Rows of the link table (_o0 = 0) come before all mutations.
_ORDER = ["_o0", "_ts", "seq", "op", "user_id", "long_url"]
MUTATION_COLS = ["id", "op", "long_url", "user_id", "commit_ts", "seq"]


def _events(links: DataFrame | None, mutations: DataFrame) -> DataFrame:
    muts = mutations.select("id", "op", "long_url", "user_id", F.col("commit_ts").alias("_ts"),
                            F.col("seq").cast("bigint").alias("seq"), F.lit(1).alias("_o0"),
                            F.col("commit_ts").alias("created_at"))
    if links is not None:
        init = links.select("id", F.lit("insert").alias("op"), "long_url", "user_id",
                            F.col("created_at").alias("_ts"), F.lit(-1).cast("bigint").alias("seq"),
                            F.lit(0).alias("_o0"), "created_at")
        muts = init.unionByName(muts)
    return muts


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` with its lineage cut, and its rows, counted on the way."""
    seen = Observation()
    cut = stable(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return cut, seen.get["n"]


def _successful_inserts(ev: DataFrame) -> DataFrame:
    """Positions of the inserts that start a life.  The first insert of an id
    always does; pointer doubling follows only ids with more of them."""
    nodes = ev.where((F.col("op") == "insert") & F.col("id").isNotNull()).select("id", POS, "nd")
    firsts = stable(nodes.groupBy("id").agg(F.min(POS).alias("at"), F.count(F.lit(1)).alias("n")))
    dels = ev.where((F.col("op") == "delete") & F.col("ni").isNotNull()).select(F.col(POS).alias("nd"), "ni")
    # An insert without a later delete that an insert follows leads nowhere, so
    # ids with one insert are not here.
    jump, left = _counted(nodes.join(dels, "nd").select(F.col(POS).alias("at"), F.col("ni").alias("nxt")))
    marked = firsts.select("at")
    if not left:
        return marked
    marked, size = _counted(marked.join(jump, "at", "left_semi"))
    while True:
        # marked = {succ^j(head) : j < 2^k}; jump = succ^(2^k).  The join runs
        # once: marked + new is written, and no growth means the walk is done.
        grown, grown_size = _counted(marked.union(marked.join(jump, "at").select("nxt")))
        if grown_size == size:
            return firsts.select("at").union(marked).distinct()
        marked, size = grown, grown_size
        far = jump.select(F.col("at").alias("nxt"), F.col("nxt").alias("_far"))
        jump = stable(jump.join(far, "nxt").select("at", F.col("_far").alias("nxt")))


def annotate_mutations(links: DataFrame | None, mutations: DataFrame) -> DataFrame:
    """Every event with its verdict: ``accepted`` and ``reason``; an event
    without id is rejected."""
    full = ordered(_events(links, mutations), ["id"], _ORDER)
    # Partitioned by id first: hash(range, id) also satisfies the clustering of
    # the second window, so it needs no second shuffle.
    ev = scan_last(full.select(POS, PART, "id", "op", "user_id"), ["id"], F.when(F.col("op") == "insert", F.col(POS)), "ni", "next")
    owner_delete = (F.col("op") == "delete") & F.col("user_id").isNotNull()
    ev = scan_last(ev, ["id", "user_id"], F.when(owner_delete, F.col(POS)), "nd", "next")
    ev = stable(ev.withColumn("nd", F.when((F.col("op") == "insert") & F.col("user_id").isNotNull(), F.col("nd"))))

    starts = _successful_inserts(ev).select(F.col("at").alias(POS), F.lit(True).alias("_start"))
    ev = ev.join(starts, POS, "left").withColumn("_start", F.coalesce("_start", F.lit(False)))
    life_val = F.when(F.col("_start"), F.struct(F.col(POS).alias("start"), F.col("user_id").alias("owner"),
                                                F.col("nd").alias("end")))
    ev = scan_last(ev, ["id"], life_val, "life", "prev", inclusive=True)

    life = F.col("life")
    alive = life.isNotNull() & (life["end"].isNull() | (F.col(POS) < life["end"]))
    is_owner = F.col("user_id").isNotNull() & (F.col("user_id") == life["owner"])
    op = F.col("op")
    accepted = (F.when(op == "insert", F.col("_start"))
                 .when(op == "update", alive & is_owner)
                 .when(op == "delete", life.isNotNull() & life["end"].eqNullSafe(F.col(POS)))
                 .otherwise(F.lit(False)))
    accepted = F.coalesce(accepted, F.lit(False))
    reason = (F.when(accepted, F.lit(None).cast("string"))
               .when(~op.isin("insert", "update", "delete"), F.lit("unknown_op"))
               .when(op == "insert", F.lit("already_exists"))
               .when(~alive, F.lit("not_found"))
               .otherwise(F.lit("not_owner")))
    verdict = ev.select(POS, "life", accepted.alias("accepted"), reason.alias("reason"))
    return full.drop(PART).join(verdict, POS)


def apply_mutations(links: DataFrame | None, mutations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """-> (links after the replay, applied mutations, rejected mutations + reason)."""
    ev = stable(annotate_mutations(links, mutations))
    out_cols = ["id", "op", "long_url", "user_id", F.col("_ts").alias("commit_ts"), "seq"]
    applied = ev.where((F.col("_o0") == 1) & F.col("accepted")).select(*out_cols)
    rejected = ev.where((F.col("_o0") == 1) & ~F.col("accepted")).select(*out_cols, "reason")
    # The last accepted insert/update of an id carries the current URL, the
    # last accepted insert the owner and the time; the id is live iff that
    # event's life has no end.
    place = F.col(POS)
    last = (ev.where(F.col("accepted") & F.col("op").isin("insert", "update"))
              .groupBy("id")
              .agg(F.max_by(F.struct("long_url", F.col("life")["owner"].alias("owner"),
                                     F.col("life")["end"].alias("end")), place).alias("s"),
                   F.max_by("created_at", F.when(F.col("op") == "insert", place)).alias("created_at")))
    final = (last.where(F.col("s")["end"].isNull())
                 .select("id", F.col("s")["long_url"].alias("long_url"), F.col("s")["owner"].alias("user_id"), "created_at"))
    return final, applied, rejected


def _with_op(rows: DataFrame, op: str) -> DataFrame:
    return rows.withColumn("op", F.lit(op)).select(*MUTATION_COLS)


def insert_links(links: DataFrame | None, rows: DataFrame):
    return apply_mutations(links, _with_op(rows, "insert"))


def update_links(links: DataFrame, rows: DataFrame):
    return apply_mutations(links, _with_op(rows, "update"))


def delete_links(links: DataFrame, rows: DataFrame):
    return apply_mutations(links, _with_op(rows, "delete"))


def latest_state(changelog: DataFrame, as_of=None) -> DataFrame:
    """State of each id after its last change (optionally as of a time: a
    timestamp text or Column); ids whose last change is a delete are
    dropped.  One partial+final aggregate: a hot id is pre-reduced on the
    map side."""
    if as_of is not None:
        cutoff = ts_literal(as_of) if isinstance(as_of, str) else as_of
        changelog = changelog.where(F.col("commit_ts") <= cutoff)
    last = changelog.groupBy("id").agg(
        F.max(F.struct("commit_ts", "seq", "op", "long_url", "user_id")).alias("s"))
    return (last.where(F.col("s")["op"] != "delete")
                .select("id", F.col("s")["long_url"].alias("long_url"), F.col("s")["user_id"].alias("user_id"),
                        F.col("s")["commit_ts"].alias("updated_at")))


def links_as_of(changelog: DataFrame, as_of: str) -> DataFrame:
    """Bounded-stale read: the value of every id as of ``as_of``."""
    return latest_state(changelog, as_of)


def stale_read(changelog: DataFrame, now: str, staleness: str = STALE_READ) -> DataFrame:
    """The link table as a read with bounded staleness sees it at ``now``
    (``staleness`` "0 seconds" is a strong read)."""
    return latest_state(changelog, ts_literal(now) - F.expr(f"INTERVAL {staleness}"))


def diff_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """inserted / updated / deleted ids between two snapshots."""
    o = old.select(F.col("id").alias("_oid"), F.col("long_url").alias("old_url"), F.col("user_id").alias("old_user"))
    n = new.select(F.col("id").alias("_nid"), F.col("long_url").alias("new_url"), F.col("user_id").alias("new_user"))
    j = o.join(n, F.col("_oid") == F.col("_nid"), "full_outer")
    change = (F.when(F.col("_oid").isNull(), F.lit("inserted"))
               .when(F.col("_nid").isNull(), F.lit("deleted"))
               .when(~F.col("old_url").eqNullSafe(F.col("new_url")) | ~F.col("old_user").eqNullSafe(F.col("new_user")),
                     F.lit("updated")))
    return (j.withColumn("change", change).where(F.col("change").isNotNull())
             .select(F.coalesce("_oid", "_nid").alias("id"), "change", "old_url", "new_url"))


def lookup_by_code(links: DataFrame, codes: DataFrame, code_col: str = "short_code",
                   link_buckets: int | None = None) -> DataFrame:
    """Many point reads as one join; each distinct code is looked up once.
    With ``link_buckets`` (a table stored by ``sinks.write_links``) only the
    partitions holding the requested codes are read."""
    distinct_codes = codes.select(F.col(code_col).alias("short_code")).distinct()
    extra = [BUCKET_COL] if BUCKET_COL in links.columns else []
    found = join_links(distinct_codes, "short_code", links.select("id", "long_url", *extra), "inner", link_buckets)
    return found.select("short_code", "long_url")


def filter_user(links: DataFrame, user: str) -> DataFrame:
    """Rows owned by ``user``; anonymous (NULL) rows never match."""
    return links.where(F.col("user_id") == F.lit(user))


def user_history(links: DataFrame, user: str) -> DataFrame:
    """A user's links, newest first (ties by id); ``rank`` carries the order."""
    rows = filter_user(links, user).select("id", "long_url", "created_at")
    return global_row_number(rows, [F.col("created_at").desc(), F.col("id").asc()], out="rank")


def require_user(df: DataFrame, user_col: str = "user_id") -> DataFrame:
    return df.withColumn("reason", F.when(blank(user_col), F.lit(REASON_UNAUTHORIZED)))


def display_columns(df: DataFrame, date_col: str = "created_at", count_col: str | None = None) -> DataFrame:
    out = df.withColumn("created_display", display_date(date_col))
    if count_col:
        out = out.withColumn("clicks_display", display_count(count_col))
    return out


def apply_retention(df: DataFrame, ts: str, now: str, keep: str) -> DataFrame:
    return df.where(F.col(ts) >= ts_literal(now) - F.expr(f"INTERVAL {keep}"))


def expire_links(links: DataFrame, now: str, ttl: str) -> DataFrame:
    """Links still within their time-to-live at ``now``."""
    return links.where(F.col("created_at") + F.expr(f"INTERVAL {ttl}") > ts_literal(now))
