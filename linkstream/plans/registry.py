"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole driver tables.  The oracle SQL is an independent statement of the
same result for DuckDB (views inlined as CTEs); computed columns carry the
same aliases on both sides.  Builders live in ``linkstream.plans.q_*``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    survey_id: str


REGISTRY: dict[str, Query] = {}


def query(name: str, survey_id: str, oracle: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, survey_id)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from linkstream.plans import (  # noqa: F401
        q_clicks, q_codes, q_links, q_patterns, q_resolve, q_rollup, q_streams, q_telemetry,
    )
    return REGISTRY
