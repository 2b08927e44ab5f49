"""Properties of whole reports on the smallest test tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.fixtures import make_tables, money
from tradelens.operators.trend import seasonal_forecast
from tradelens.plans import reports as R
from tradelens.plans.catalog import TEST_PARAMS as P
from tradelens.plans.catalog import tables_for


def test_summary_total_equals_ranked_total(spark):
    t = tables_for(spark, SF_SMALL)
    total = R.ranked_categories(t, P).agg(F.sum("sales")).first()[0]
    summary = R.category_sales_summary(t, P).agg(F.sum("sales")).first()[0]
    assert abs(total - summary) < 1e-6 * total


def test_shares_sum_to_one(spark):
    t = tables_for(spark, SF_SMALL)
    assert abs(R.share_of_total_report(t, P).agg(F.sum("share")).first()[0] - 1.0) < 1e-12


def test_histogram_counts_sum_to_rows(spark):
    t = tables_for(spark, SF_SMALL)
    rows = R.order_cost_split(t, P).count()
    assert R.product_cost_hist(t, P).agg(F.sum("count")).first()[0] == rows
    assert R.shipping_cost_hist(t, P).agg(F.sum("count")).first()[0] == rows


def test_rfm_counts_sum_to_scored_people(spark):
    t = tables_for(spark, SF_SMALL)
    people = R.ntile_scores(t, P)
    assert people.filter(F.col("rfm_bucket").isNull()).count() == 0
    assert R.rfm_segments(t, P).agg(F.sum("customer_count")).first()[0] == people.count()
    sizes = sorted(r["count"] for r in people.groupBy("recency").count().collect())
    assert sizes[-1] - sizes[0] <= 1          # NTILE tiles differ by at most one row


def test_pairs_do_not_depend_on_basket_order(spark):
    t = tables_for(spark, SF_SMALL)
    p = R.Params(**{**P.__dict__, "pair_min": 1})
    a = {tuple(r) for r in R.co_purchased_products(t, p).collect()}
    rev = t.replaced(items=t.items.orderBy(F.desc("order_id"), F.desc("seller_id")))
    b = {tuple(r) for r in R.co_purchased_products(rev, p).collect()}
    assert a == b and all(r[0] < r[1] for r in a)


def test_e10_zero_fit_gives_null_forecast(spark):
    daily = spark.createDataFrame([("x", 0, Decimal("5.00")), ("x", 1, Decimal("7.00"))],
                                  "category string, day int, sales decimal(18,2)")
    model = spark.createDataFrame([("x", 1.0, 0.0)], "category string, slope double, intercept double")
    out = {r.day: r.forecast for r in seasonal_forecast(daily, model, ["category"], "day", "sales", 1, 0, 5)
           .collect()}
    assert out[0] is None                     # fit(day 0) = 0: no division error, NULL
    assert out[1] == 2.0 / 1.0 * 7.0


def test_e26_untranslated_category_absent(spark):
    t = make_tables(spark, products=[(1, "c1", 1), (2, "zz", 1), (3, None, 1)], category_names=[("c1", "one")],
                    items=[(1, 1, 9, money(1), money(0)), (1, 2, 9, money(1), money(0)), (1, 3, 9, money(1), money(0))],
                    orders=[(1, 1, "delivered", None, None, None, None, None)])
    assert {r.category for r in R.ranked_categories(t, R.Params()).collect()} == {"one"}
