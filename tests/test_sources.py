"""Marketplace export loader and sinks."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

from tradelens.plans import reports as R
from tradelens.sources import marketplace_tables, preview, write_report


def _write(spark, root, name, rows, schema, fmt="parquet"):
    df = spark.createDataFrame(rows, schema)
    path = os.path.join(root, f"{name}.{fmt}")
    if fmt == "csv":
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def test_marketplace_loader_csv(spark):
    test_marketplace_loader_and_report(spark, fmt="csv")


def test_marketplace_loader_and_report(spark, fmt="parquet"):
    root = tempfile.mkdtemp(prefix="tl-export-", dir="/tmp")

    def w(*args):
        _write(*args, fmt=fmt)

    t0 = dt.datetime(2017, 3, 5, 10, 0)
    w(spark, root, "orders", [("o1", "c1", "delivered", t0, t0, t0, t0 + dt.timedelta(days=3),
                                    t0 + dt.timedelta(days=10))],
           "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
           "order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
           "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz")
    w(spark, root, "customers", [("c1", "u1", "sao paulo", 1234)],
           "customer_id string, customer_unique_id string, customer_city string, customer_zip_code_prefix int")
    w(spark, root, "order_items", [("o1", "p1", "s1", Decimal("10.50"), Decimal("2.25"))],
           "order_id string, product_id string, seller_id string, price decimal(10,2), freight_value decimal(10,2)")
    w(spark, root, "products", [("p1", "beleza_saude", 500.0)],
           "product_id string, product_category_name string, product_weight_g double")
    w(spark, root, "product_category_name_translation", [("beleza_saude", "health_beauty")],
           "product_category_name string, product_category_name_english string")
    w(spark, root, "order_payments", [("o1", Decimal("12.75"))], "order_id string, payment_value decimal(10,2)")
    w(spark, root, "order_reviews", [("r1", "o1", 5, "otimo")],
           "review_id string, order_id string, review_score int, review_comment_message string")
    w(spark, root, "geolocation", [(1234, -23.5, -46.6)],
           "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double")
    w(spark, root, "sellers", [("s1",)], "seller_id string")
    w(spark, root, "leads_qualified", [("m1", "organic_search")], "mql_id string, origin string")
    w(spark, root, "leads_closed", [("m1",)], "mql_id string")

    t = marketplace_tables(spark, root, fmt=fmt)
    p = R.Params(as_of="2018-01-01")
    assert R.order_value_stats(t, p).first().avg_order_price == 12.75
    assert R.top_cities(t, p).first().city == "SAO PAULO"
    seg = R.rfm_segments(t, p).first()
    assert seg.rfm_bucket == "Champions" and seg.customer_count == 1
    assert R.lead_conversion(t, p).first().conversion_rate == 100.0

    out = os.path.join(root, "out_csv")
    write_report(R.category_sales_summary(t, p), out, fmt="csv")
    back = spark.read.option("header", True).csv(out)
    assert sorted(r.category for r in back.collect()) == ["Other categories", "health_beauty"]
    assert preview(t.orders, 1, columns=[0, 2], order_by=["order_id"]).columns == ["order_id", "status"]


def test_colocated_order_facts_join_without_shuffle(spark):
    from tests.conftest import SF_SMALL
    from tradelens.sources.tables import colocate_order_facts, star_tables

    where = tempfile.mkdtemp(prefix="tl-colocated-", dir="/tmp")
    t = colocate_order_facts(star_tables(spark, SF_SMALL), where, 4, database="tl_test")
    joined = t.items.join(t.orders, "order_id").groupBy("order_id").count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    base = star_tables(spark, SF_SMALL)
    assert joined.count() == base.items.join(base.orders, "order_id").select("order_id").distinct().count()


def test_write_text_lines_keeps_whole_texts_in_order(spark):
    from tradelens.sources import write_text_lines

    df = spark.createDataFrame([(2, "second text"), (1, "first text\nwith two lines")], "id long, t string")
    out = tempfile.mkdtemp(prefix="tl-text-", dir="/tmp")
    write_text_lines(df, "t", os.path.join(out, "doc"), order_by=["id"])
    text = "".join(open(os.path.join(out, "doc", f)).read()
                   for f in sorted(os.listdir(os.path.join(out, "doc"))) if f.startswith("part-"))
    assert text == "first text\nwith two lines\nsecond text\n"


def test_command_line_runs_a_report(spark):
    from tests.conftest import SF_SMALL
    from tradelens.__main__ import main

    out = os.path.join(tempfile.mkdtemp(prefix="tl-cli-", dir="/tmp"), "bands")
    assert main(["run", "sellers_per_band", "--layout", "star", "--data", SF_SMALL, "--out", out,
                 "--format", "csv", "--param", "band_edges=1,5,10"]) == 0
    rows = spark.read.option("header", True).csv(out).collect()
    assert {r.bucket for r in rows} <= {"1-4 orders", "5-9 orders", "10+ orders"}
    assert sum(int(r.seller_count) for r in rows) == spark.read.parquet(f"{SF_SMALL}/supplier.parquet").count()


def test_reports_over_colocated_tables_are_unchanged(spark):
    from tests.conftest import SF_SMALL
    from tradelens.plans import reports as R
    from tradelens.plans.catalog import TEST_PARAMS
    from tradelens.sources.tables import colocate_order_facts, star_tables

    base = star_tables(spark, SF_SMALL)
    where = tempfile.mkdtemp(prefix="tl-colocated-", dir="/tmp")
    stored = colocate_order_facts(base, where, 4, database="tl_test_reports")
    for report in (R.order_value_stats, R.seller_scorecard, R.order_cost_split):
        assert sorted(report(stored, TEST_PARAMS).collect()) == sorted(report(base, TEST_PARAMS).collect())


REVIEWS = 'review_id,order_id,review_score,review_comment_message\nr1,o1,1,"late ""again""\nnever came"\nr2,o2,5,\n'


def test_csv_comments_are_read_whole(spark, tmp_path):
    (tmp_path / "order_reviews.csv").write_text(REVIEWS)
    for root in (str(tmp_path), f"file://{tmp_path}"):
        t = marketplace_tables(spark, root, fmt="csv")   # the other tables are not there, and not needed
        rows = sorted((r.review_id, r.score, r.comment) for r in t.comments.collect())
        assert rows == [("r1", 1, 'late "again"\nnever came'), ("r2", 5, None)]


def test_layouts_by_path_and_uri(spark, tmp_path):
    spark.createDataFrame([("s1",)], "seller_id string").write.parquet(str(tmp_path / "a" / "sellers"))
    spark.createDataFrame([("s1",)], "seller_id string").write.parquet(str(tmp_path / "b" / "sellers.parquet"))
    for root, layout in (("a", "{name}"), ("b", "{name}.{fmt}")):
        for prefix in ("", "file://"):
            assert marketplace_tables(spark, f"{prefix}{tmp_path}/{root}", layout=layout).sellers.count() == 1


def test_csv_sink_round_trip(spark, tmp_path):
    rows = [("a", 'he said "no"\nand left', 1.5), ("b,c", "", 2.0), ("d", None, 3.25), ("e", "back\\slash\\", 4.0)]
    df = spark.createDataFrame(rows, "k string, t string, v double")
    write_report(df, str(tmp_path / "out"), fmt="csv")
    from tradelens.sources.tables import read_table
    back = read_table(spark, str(tmp_path), "out", "csv", "k string, t string, v double", layout="{name}")
    assert sorted(back.collect()) == sorted(df.collect())


def test_only_free_text_csv_is_one_task(spark, tmp_path):
    rows = "".join(f"c{i},u{i},town,SP,{i}\n" for i in range(20_000))
    (tmp_path / "customers.csv").write_text("customer_id,customer_unique_id,customer_city,customer_state,customer_zip_code_prefix\n" + rows)
    (tmp_path / "order_reviews.csv").write_text(REVIEWS + "".join(f'r{i},o{i},1,"line {i}\nnext"\n' for i in range(3, 20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        t = marketplace_tables(spark, str(tmp_path), fmt="csv")
        assert t.customers.rdd.getNumPartitions() > 4 and t.customers.count() == 20_000
        assert t.comments.rdd.getNumPartitions() == 1 and t.comments.count() == 19_999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
