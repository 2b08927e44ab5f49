"""Reports whose tasks held a table of (order, seller) pairs: same rows from sorted orders, partitions that stay apart."""

import contextlib
import io
import re

from tests.conftest import SF_SMALL
from tests.fixtures import make_tables, money, order
from tradelens.operators.affinity import co_purchase_pairs
from tradelens.plans import reports as R
from tradelens.plans.catalog import TEST_PARAMS, tables_for

LOW = R.Params(as_of="2018-01-01", scorecard_min=0)


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_scorecard_counts_orders_from_sorted_items(spark):
    plan = plan_of(R.seller_scorecard_dedup(tables_for(spark, SF_SMALL), TEST_PARAMS))
    held = re.findall(r"keys=\[seller_id#\d+L, order_id#\d+L|keys=\[order_id#\d+L, seller_id#\d+L", plan)
    assert not held and "REPARTITION_BY_NUM" in plan


def test_scorecard_of_repeated_and_null_keys(spark):
    orders = [order(i, 10, "2017-01-01 00:00:00") for i in (1, 2, 2, 3)]
    items = [(o, 7, s, money(10), money(1)) for o, s in
             [(1, 70), (1, 71), (1, 70), (2, 70), (2, 71), (None, 70), (9, 70), (3, None), (3, 71), (3, 71), (1, None)]]
    reviews = [(1, 5), (1, 3), (2, None), (None, 1), (9, 1)]
    t = make_tables(spark, orders=orders, items=items, reviews=reviews, sellers=[(70,), (71,), (72,)])
    got = {tuple(r) for r in R.seller_scorecard_dedup(t, LOW).collect()}
    assert got == {(70, 4.0, 30.0, 2), (71, 4.0, 40.0, 3)}


def test_pairs_of_usual_baskets_come_from_sorted_rows(spark):
    plan = plan_of(R.co_sold_sellers(tables_for(spark, SF_SMALL), TEST_PARAMS))
    held = re.findall(r"keys=\[(?:seller_id#\d+L, order_id#\d+L|order_id#\d+L, seller_id#\d+L)", plan)
    assert not held and "REPARTITION_BY_NUM" in plan


def test_pairs_of_repeated_and_null_keys(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (1, None), (2, "b"), (2, "a"), (None, "a"), (None, "b"), (3, "a"), (3, "c"),
            *[(4, c) for c in "abcdefgh"]]
    items = spark.createDataFrame(rows, "basket long, item string")
    for most in (2, 16, 1000):  # the last basket is dealt to several tasks, then joined as a whole, then sorted
        got = co_purchase_pairs(items, "basket", "item", items.select("item").distinct(), 1, pairs_per_task=most)
        assert sorted(map(tuple, got.collect())) == [("a", "b", 3)] + [("a", "c", 2)]
