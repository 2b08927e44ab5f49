"""Report state: refreshed days equal a full run, readers see whole versions, and only the named days are read."""

import re

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tradelens.plans import state as S
from tradelens.plans.catalog import TEST_PARAMS as P
from tradelens.plans.catalog import tables_for
from tradelens.sources.tables import marketplace_tables, partition_facts_by_month


def rows(df):
    return sorted(map(tuple, df.select("day", "category", "orders", "items", "sales").collect()), key=str)


def test_a_refresh_equals_a_full_run(spark, tmp_path):
    t = tables_for(spark, SF_SMALL)
    state = S.ReportState(spark, str(tmp_path / "state"), S.STATE_SCHEMA)
    assert state.read().collect() == []
    S.refresh(state, t, P, "2000-01-01", "2000-03-01")
    before = state.read()
    first = rows(before)
    S.refresh(state, t, P, "2000-03-01", "2000-03-02")  # a new day
    late = t.replaced(orders=t.orders.filter("day(purchased) % 7 <> 0"))
    S.refresh(state, late, P, "2000-02-10", "2000-02-20")  # days again, with other facts
    want = S.daily_facts(t, P, "2000-01-01", "2000-02-10").unionByName(S.daily_facts(late, P, "2000-02-10", "2000-02-20")).unionByName(
        S.daily_facts(t, P, "2000-02-20", "2000-03-02"))
    assert rows(state.read()) == rows(want)
    assert rows(before) == first  # what a reader had opened is still whole
    S.refresh(state, late, P, "2000-02-10", "2000-02-20")
    assert state.clean(keep=1) == 1 and rows(state.read()) == rows(want)  # the refresh that was replaced as a whole
    months = {r.month: r.order_count for r in S.orders_by_month(state.read()).collect()}
    plain = t.orders.filter("purchased >= '2000-01-01' and purchased < '2000-02-01'").count()
    assert months["2000-01"] == plain
    S.refresh(state, t.replaced(orders=t.orders.limit(0)), P, "2000-01-01", "2000-04-01")  # all days without rows
    assert state.read().collect() == []


def test_a_refresh_reads_its_days_only(spark, tmp_path):
    t = tables_for(spark, SF_SMALL)
    t.orders.select("order_id", "customer_id", F.col("status").alias("order_status"), F.col("purchased").alias("order_purchase_timestamp"),
                    F.col("approved").alias("order_approved_at"), F.col("to_carrier").alias("order_delivered_carrier_date"),
                    F.col("delivered").alias("order_delivered_customer_date"), F.col("estimated").alias("order_estimated_delivery_date")
                    ).write.parquet(str(tmp_path / "orders.parquet"))
    m = marketplace_tables(spark, str(tmp_path))
    mixed = t.replaced(orders=m.orders)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = S.daily_facts(mixed, P, "2000-03-01", "2000-03-02")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [ln for ln in plan.splitlines() if "FileScan" in ln and "order_purchase_timestamp" in ln]
    assert pushed and all(re.search(r"PushedFilters:.*GreaterThanOrEqual\(order_purchase_timestamp,2000-03-01.*"
                                    r"LessThan\(order_purchase_timestamp,2000-03-02", ln) for ln in pushed)


def test_facts_by_month_are_pruned_on_both_sides(spark, tmp_path):
    base = tables_for(spark, SF_SMALL)
    t = partition_facts_by_month(base, str(tmp_path))
    assert t.orders.drop("month").exceptAll(base.orders).count() == 0 and t.items.count() == base.items.count()
    facts = S.daily_facts(t, P, "2000-02-10", "2000-03-05")
    assert rows(facts) == rows(S.daily_facts(base, P, "2000-02-10", "2000-03-05"))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.splitlines() if "FileScan" in ln and "month#" in ln]
    assert len(scans) >= 3  # orders twice, items
    assert all(re.search(r"PartitionFilters: \[[^\]]*month#\d+ >= 2000-02", ln) for ln in scans), scans
