"""Physical plan checks: pushdown, bounded broadcast, top-k, no Python in hot paths."""

from linkstream.plans.registry import load_all
from tests.conftest import SF01

REG = load_all()


def plan(spark, name):
    return REG[name].build(spark, SF01)._jdf.queryExecution().executedPlan().toString()


def test_top_links_enriched_plan(spark):
    p = plan(spark, "top_links_enriched")
    assert "TakeOrderedAndProject" in p
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p


def test_filter_pushed_to_scan(spark):
    assert "EqualTo(event_type,click)" in plan(spark, "hourly_rollup")
    p = plan(spark, "totals_last_24h")
    assert "EqualTo(event_type,click)" in p and "GreaterThanOrEqual(ts," in p


def test_sliding_windows_expand_counts_only(spark):
    p = plan(spark, "trending_topn")
    assert p.index("Expand") < p.index("partial_count(1)")  # the plan prints from the top: counts lie below


def test_column_pruning(spark):
    p = plan(spark, "hourly_rollup")
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in p


def test_no_python_udf_in_hot_paths(spark, monkeypatch):
    cls, seen = type(spark.range(1)), []
    cut = cls.checkpoint

    def recorded(self, *a, **k):  # the plans in front of a checkpoint count too
        seen.append(self._jdf.queryExecution().executedPlan().toString())
        return cut(self, *a, **k)

    monkeypatch.setattr(cls, "checkpoint", recorded)
    for name in ["hourly_rollup", "resolve_redirects", "sessions", "trending_topn", "rolling_avg",
                 "apply_mutations_links", "service_map", "top_links_enriched"]:
        seen.clear()
        p = plan(spark, name) + "".join(seen)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert name != "apply_mutations_links" or len(seen) > 3


def test_trending_uses_group_limit(spark):
    assert "WindowGroupLimit" in plan(spark, "trending_topn")


def test_stored_links_are_pruned_dynamically(spark):
    p = plan(spark, "top_links_enriched_stored")
    assert "dynamicpruning" in p.lower()
