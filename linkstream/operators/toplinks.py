"""Top links: ranking, paging, enrichment with destinations, JSON response.

Plan shape of ``top_links_enriched`` (default, limit before enrichment)::

    rollup scan -> partial HashAggregate -> shuffle(short_code)
      -> final HashAggregate -> TakeOrderedAndProject(n)
      -> BroadcastHashJoin(build = the n rows) <- links scan (filter pushed)

Only the ``n`` ranked rows are broadcast; the link table is streamed, never
shuffled.  The per-row lookups of the original service become one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkstream.constants import TOP_LINKS_N
from linkstream.operators.rollup import clicks_by_code
from linkstream.plans.joins import BUCKET_COL, bounded, bounded_broadcast, join_links

def _order():
    return [F.col("total_clicks").desc(), F.col("short_code").asc()]


def _live_links(links: DataFrame) -> DataFrame:
    """Links with a usable destination (missing or empty URLs are dropped)."""
    extra = [BUCKET_COL] if BUCKET_COL in links.columns else []
    return (links.where(F.col("long_url").isNotNull() & (F.col("long_url") != ""))
                 .select(F.col("id"), F.col("long_url"), *extra))


def _with_rank(df: DataFrame) -> DataFrame:
    # Applied only to <= n rows (after a LIMIT), so the un-partitioned window
    # runs on a bounded single partition.
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*_order())).cast("bigint"))


def top_links(rollup: DataFrame, n: int = TOP_LINKS_N) -> DataFrame:
    """Codes by merged clicks, descending; ties broken by code ascending."""
    return _with_rank(clicks_by_code(rollup).orderBy(*_order()).limit(bounded(n)))


def top_links_enriched(rollup: DataFrame, links: DataFrame, n: int = TOP_LINKS_N,
                       drop_deleted: str = "after_limit", link_buckets: int | None = None) -> DataFrame:
    """Top ``n`` codes with their destination URL.

    ``after_limit`` (the original behaviour): rank first, then drop codes whose
    link is gone, so fewer than ``n`` rows may come back.
    ``before_limit``: drop dead codes first, then rank, always ``n`` rows if
    that many live codes were clicked.
    ``link_buckets``: the link table is stored by ``sinks.write_links``;
    only the partitions of the ranked codes are read.
    """
    live = _live_links(links)
    if drop_deleted == "after_limit":
        top = bounded_broadcast(clicks_by_code(rollup).orderBy(*_order()).limit(bounded(n)), n)
        joined = join_links(top, "short_code", live, "inner", link_buckets)
    elif drop_deleted == "before_limit":
        totals = clicks_by_code(rollup)
        joined = (totals.join(live, totals["short_code"] == live["id"], "inner")
                        .orderBy(*_order()).limit(bounded(n)))
    else:
        raise ValueError(f"drop_deleted must be after_limit or before_limit, not {drop_deleted!r}")
    return _with_rank(joined.select("short_code", "long_url", "total_clicks"))


def enrich_top(top: DataFrame, links: DataFrame, n: int = TOP_LINKS_N, link_buckets: int | None = None) -> DataFrame:
    """``n`` ranked (short_code, total_clicks) at most -> those with a live link, ranked."""
    joined = join_links(bounded_broadcast(top, n), "short_code", _live_links(links), "inner", link_buckets)
    return _with_rank(joined.select("short_code", "long_url", "total_clicks"))


def best(totals: DataFrame, n: int = TOP_LINKS_N) -> DataFrame:
    """The first ``n`` of one total a code."""
    return totals.select("short_code", "total_clicks").orderBy(*_order()).limit(bounded(n))


def top_links_page(rollup: DataFrame, links: DataFrame, page: int = 1,
                   limit: int = TOP_LINKS_N) -> DataFrame:
    """One page of the ranking; ``has_next`` is true iff the page is full."""
    if page < 1 or limit < 1:
        raise ValueError("page and limit must be >= 1")
    offset = (page - 1) * limit
    ranked = clicks_by_code(rollup).orderBy(*_order()).offset(offset).limit(bounded(limit))
    # <= limit rows: the un-partitioned count is a bounded single partition.
    ranked = ranked.withColumn(
        "has_next", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) == F.lit(limit))
    top = bounded_broadcast(ranked, limit)
    live = _live_links(links)
    page_rows = top.join(live, top["short_code"] == live["id"], "inner")
    return (page_rows.select("short_code", "long_url", "total_clicks", "has_next")
                     .withColumn("rank", (F.row_number().over(Window.orderBy(*_order())) + F.lit(offset))
                                 .cast("bigint")))


def orphan_clicks(rollup: DataFrame, links: DataFrame) -> DataFrame:
    """Clicked codes with no live link (deleted or never created)."""
    totals = clicks_by_code(rollup)
    live = _live_links(links)
    return totals.join(live, totals["short_code"] == live["id"], "left_anti")


def top_links_json(top: DataFrame) -> DataFrame:
    """``{"top_links":[{short_code,long_url,total_clicks},...]}`` in rank order.

    ``top`` is bounded (a top-n result), so gathering it into one array is a
    bounded global aggregate.  No rows give ``[]``, never ``null``.
    """
    items = F.collect_list(F.struct("rank", "short_code", "long_url", "total_clicks"))
    ordered = F.transform(F.array_sort(items),
                          lambda x: F.struct(x["short_code"].alias("short_code"),
                                             x["long_url"].alias("long_url"),
                                             x["total_clicks"].alias("total_clicks")))
    return top.agg(F.to_json(F.struct(ordered.alias("top_links"))).alias("json"))
