"""Plan checks: pushdown, pruning and no whole-table single-partition windows."""

import re

from tests.conftest import SF_SMALL
from tradelens.plans.catalog import queries, tables_for
from tradelens.sources.tables import TABLE_NAMES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _single_partition_windows(plan: str) -> list[str]:
    """Window operators fed by an Exchange SinglePartition (a whole-input window)."""
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-"))
        for j in range(i - 1, -1, -1):
            d = len(lines[j]) - len(lines[j].lstrip(" :+-"))
            if d < depth:
                name = lines[j].strip(" :+-")
                if name.startswith("Sort"):
                    depth = d
                    continue
                if name.startswith("Window"):
                    bad.append(name[:120])
                break
    return bad


def test_rfm_scores_have_no_global_window(spark):
    df = queries()["ntile_scores"](spark, SF_SMALL)
    assert _single_partition_windows(_plan(df)) == []


def test_filters_reach_parquet(spark):
    plan = _plan(queries()["order_cost_split"](spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", plan)


def test_column_pruning_on_lineitem(spark):
    plan = _plan(queries()["seller_bands"](spark, SF_SMALL))
    scans = [ln for ln in plan.splitlines() if "lineitem" in ln or "ReadSchema" in ln]
    assert any("ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in s for s in scans)


def test_no_cross_joins_anywhere(spark):
    bad = []
    for key, fn in queries().items():
        plan = _plan(fn(spark, SF_SMALL))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(key)
    assert bad == []


def _scans(plan: str, table: str) -> int:
    return sum("FileScan" in ln and f"{table}.parquet" in ln for ln in plan.splitlines())


def test_weights_are_counted_once(spark):
    for key in ("weight_box_stats", "category_median_weight"):
        assert _scans(_plan(queries()[key](spark, SF_SMALL)), "lineitem") <= 2


def test_products_are_joined_before_orders(spark):
    for key in ("monthly_category_sales", "daily_category_sales", "category_trend", "fastest_growing", "regression_lines"):
        plan = queries()[key](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joins = [(len(ln) - len(ln.lstrip(" :+-")), ln) for ln in plan if "Join Inner" in ln]
        outer = min(joins)[1]
        assert "order_id" in outer and "product_id" not in outer, outer


def _jobs_while(spark, group, build) -> int:
    spark.sparkContext.setJobGroup(group, "")
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_few_jobs_while_plans_are_built(spark):
    """Checkpoints for NTILE and distributions with their cells (each a job per shuffle or broadcast), one for the top
    terms, the refreshes of the state, none elsewhere."""
    for name in TABLE_NAMES:  # opening a Parquet table reads its footer in a job
        getattr(tables_for(spark, SF_SMALL), name)
    most = {k: 20 for k in ("ntile_scores", "rfm_segments", "rfm_bubbles", "delivery_box_stats", "weight_box_stats",
                            "category_median_weight", "ordered_weights", "december_forecast")} | {"table_preview": 1, "top_negative_terms": 8, "monthly_sales_from_state": 60, "quarter_sales_of_monthly_facts": 30}
    for key, fn in queries().items():
        jobs = _jobs_while(spark, f"building {key}", lambda fn=fn: fn(spark, SF_SMALL))
        assert jobs <= most.get(key, 0), (key, jobs)
