"""Edge fixtures E1-E26 (FIXTURES.md part C) on literal tables."""

from pyspark.sql import functions as F

from tests.fixtures import make_tables, money, order, ts
from tradelens.functions import between_half_open, elapsed_days, shift_year, weekday_label, weekday_number
from tradelens.operators.affinity import co_purchase_pairs
from tradelens.operators.aggregates import pivot_measure, top_n_with_other
from tradelens.operators.bands import volume_band
from tradelens.operators.trend import centered_mean, fit_line
from tradelens.plans import reports as R

P = R.Params(as_of="2018-01-01", frequent_min=0, pair_min=1, scorecard_min=0,
             top_categories=18)


def test_e1_half_open_range(spark):
    df = spark.createDataFrame([(ts("2018-08-29 00:00:00"),), (ts("2018-08-29 10:00:00"),),
                                (ts("2018-08-28 23:59:59"),)], "t timestamp_ntz")
    kept = df.filter(between_half_open("t", "2018-01-01", "2018-08-29")).collect()
    assert [r.t for r in kept] == [ts("2018-08-28 23:59:59")]


def test_e2_e3_e4_time_columns(spark):
    df = spark.createDataFrame([(ts("2017-01-01 00:00:00"), ts("2017-01-02 12:00:00")), (ts("2017-12-31 09:05:00"), None)],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(elapsed_days("a", "b").alias("d"), weekday_number("a").alias("w"), weekday_label("a").alias("n"),
                  F.hour("a").alias("h")).collect()
    assert r[0].d == 1.5 and r[1].d is None
    assert (r[1].w, r[1].n, r[1].h) == (0, "Sun", 9)
    leap = spark.createDataFrame([("2016-02-29",)], "d string").select(shift_year(F.to_date("d")).alias("x"))
    assert str(leap.first().x) == "2017-02-28"


def test_e5_pivot_fill(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (2, 0, 1.0)], "k int, h int, v double")
    c = {r.k: (r.a, r.b) for r in pivot_measure(df, ["k"], "h", [0, 1], ["a", "b"], "count").collect()}
    assert c == {1: (1, 1), 2: (1, 0)}
    s = {r.k: (r.a, r.b) for r in pivot_measure(df, ["k"], "h", [0, 1], ["a", "b"], "sum", "v").collect()}
    assert s == {1: (2.0, None), 2: (1.0, None)}


def test_e6_e7_top_with_other(spark):
    few = spark.createDataFrame([("a", 3, 1), ("b", 2, 2), ("c", 1, 3)], "c string, s int, r int")
    out = {r.c: r.s for r in top_n_with_other(few, "c", "s", "r", 18, "Other").collect()}
    assert out == {"a": 3, "b": 2, "c": 1, "Other": None}
    tied = spark.createDataFrame([("a", 3, 1), ("b", 2, 2), ("c", 2, 2), ("d", 1, 4)], "c string, s int, r int")
    out = {r.c: r.s for r in top_n_with_other(tied, "c", "s", "r", 2, "Other").collect()}
    assert out == {"a": 3, "b": 2, "c": 2, "Other": 1}


def test_e9_single_point_regression(spark):
    df = spark.createDataFrame([("x", 1, money(5)), ("y", 2, money(1)), ("y", 2, money(3))],
                               "g string, d int, s decimal(18,2)")
    out = {r.g: (r.slope, r.intercept) for r in fit_line(df, ["g"], "d", "s").collect()}
    assert out == {"x": (None, None), "y": (None, None)}
    line = spark.createDataFrame([("z", 0, money(1)), ("z", 1, money(3)), ("z", 2, money(5))],
                                 "g string, d int, s decimal(18,2)")
    r = fit_line(line, ["g"], "d", "s").first()
    assert (r.slope, r.intercept) == (2.0, 1.0)


def test_e11_centered_mean_by_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 5, 3.0), ("a", 6, None), ("a", 9, 5.0)],
                               "g string, d int, v double")
    out = {r.d: r.m for r in centered_mean(df, ["g"], "d", "v", 2, 2, "m").collect()}
    assert out == {1: 2.0, 2: 2.0, 5: 11 / 4, 6: 10 / 3, 9: 4.0}


def _acl_tables(spark):
    orders = [order(1, 10, "2017-01-01 00:00:00"), order(2, 10, "2017-01-07 23:45:00"),
              order(3, 20, "2017-01-01 00:00:00"), order(4, 20, "2017-01-08 00:00:00"),
              order(5, 30, "2017-01-01 00:00:00"), order(6, 30, "2017-01-22 00:00:00")]
    customers = [(10, 100, "x", 1), (20, 200, "x", 1), (30, 300, "y", 2)]
    payments = [(1, money(1)), (1, money(2)), (1, money(3)), (2, money(4)), (3, money(1)), (4, money(1)),
                (5, money(7)), (6, money(7))]
    geo = [(1, 1.0, 2.0), (1, 3.0, 4.0), (1, 5.0, 6.0), (2, 0.0, 0.0)]
    return make_tables(spark, orders=orders, customers=customers, payments=payments, geo=geo)


def test_e14_e15_e16_lifetime_value(spark):
    t = _acl_tables(spark)
    clv = {r.person_id: (r.pf, r.aov, r.acl) for r in R.customer_lifetime_value(t, P).collect()}
    assert clv[100] == (2, 5.0, 1.0)          # span 6.99 days -> 1; three payments summed
    assert clv[200] == (2, 1.0, 1.0)          # span 7 days -> 7/7
    assert clv[300] == (2, 7.0, 3.0)          # 21 days -> 3 weeks
    area = {r.zip_prefix: (r.customer_count, r.latitude) for r in R.clv_by_area(t, P).collect()}
    assert area[1] == (2, 3.0)                # geo points averaged, customers not multiplied
    raw = {r.zip_prefix: (r.customer_count, r.latitude) for r in R.clv_by_area_raw(t, P).collect()}
    assert raw[1] == (6, 3.0)                 # original count: 2 customers x 3 points


def test_e17_e18_pairs(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "a"), (3, "a"), (3, "c")],
                                  "o long, k string")
    cands = items.select("k").distinct()
    got = co_purchase_pairs(items, "o", "k", cands, 1).collect()
    assert [(r.k1, r.k2, r.common_orders_count) for r in got] == [("a", "b", 2)]
    assert co_purchase_pairs(items, "o", "k", cands, 2).count() == 0      # strict >
    salted = co_purchase_pairs(items, "o", "k", cands, 0, pairs_per_task=1)
    plain = co_purchase_pairs(items, "o", "k", cands, 0)
    assert sorted(salted.collect()) == sorted(plain.collect())


def test_e19_scorecard_fanout(spark):
    orders = [order(1, 10, "2017-01-01 00:00:00")]
    items = [(1, 7, 70, money(10), money(1)), (1, 8, 70, money(20), money(1))]
    reviews = [(1, 5), (1, 3)]
    t = make_tables(spark, orders=orders, items=items, reviews=reviews, sellers=[(70,), (71,)])
    raw = R.seller_scorecard(t, P).collect()
    assert [(r.seller_id, r.num_orders, r.total_sales, r.avg_review_score) for r in raw] == [(70, 4, 60.0, 4.0)]
    dedup = R.seller_scorecard_dedup(t, P).collect()
    assert [(r.seller_id, r.num_orders, r.total_sales, r.avg_review_score) for r in dedup] == [(70, 1, 30.0, 4.0)]


def test_e20_e21_leads(spark):
    t = make_tables(spark, leads=[(1, None), (2, "unknown"), (3, "ads")], closed=[(1,), (1,), (3,)])
    out = {r.origin: (r.qualified_leads, r.closed_leads, r.conversion_rate) for r in R.lead_conversion(t, P).collect()}
    assert out == {"unknown": (2, 1, 50.0), "ads": (1, 1, 100.0)}


def test_e22_negative_comments_skip_null(spark):
    t = make_tables(spark, comments=[(1, 1, None), (2, 2, "b b"), (3, 1, "a"), (4, 5, "zz")])
    rows = R.negative_comment_text(t, P).orderBy("review_id").collect()
    assert [r.comment for r in rows] == ["b b", "a"]
    terms = {r.word: r["count"] for r in R.negative_terms(t, P).collect()}
    assert terms == {"a": 1, "b": 2}           # words of one letter count too
    t2 = make_tables(spark, comments=[(1, 1, "Atraso atraso, produto!")])
    assert {r.word: r["count"] for r in R.negative_terms(t2, P).collect()} == {"atraso": 2, "produto": 1}


def test_e24_band_none(spark):
    df = spark.createDataFrame([(0,), (1,), (10,), (999,), (1000,)], "n int")
    labels = [r.b for r in df.select(volume_band("n", [1, 10, 100, 1000]).alias("b")).collect()]
    assert labels == ["none", "1-9 orders", "10-99 orders", "100-999 orders", "1000+ orders"]


def test_e25_e26_affinity_and_categories(spark):
    orders = [order(1, 10, "2017-01-01 00:00:00"), order(2, 10, "2017-01-02 00:00:00")]
    items = [(1, 1, 70, money(1), money(0)), (1, 2, 70, money(1), money(0)), (2, 1, 70, money(1), money(0)),
             (2, 2, 70, money(1), money(0)), (2, 3, 70, money(1), money(0)), (1, 4, 70, money(1), money(0))]
    products = [(1, "c1", 100), (2, "c1", 200), (3, "c2", 300), (4, None, 400)]
    names = [("c1", "cat one"), ("c2", "cat two")]
    t = make_tables(spark, orders=orders, items=items, products=products, category_names=names)
    verts = {r.product_id for r in R.affinity_vertices(t, P).collect()}
    assert verts == {1, 2}                      # product 3 has no edge, product 4 no category
    cats = {r.category for r in R.ranked_categories(t, P).collect()}
    assert cats == {"cat one", "cat two"}


def test_pairs_match_brute_force(spark):
    import itertools
    import random
    rnd = random.Random(5)
    rows = [(o, rnd.randint(1, 12)) for o in range(300) for _ in range(rnd.randint(1, 6))]
    rows += [(999, k) for k in range(1, 13)] * 2          # one large basket, duplicated items
    items = spark.createDataFrame(rows, "o long, k long")
    baskets = {}
    for o, k in rows:
        baskets.setdefault(o, set()).add(k)
    want = {}
    for ks in baskets.values():
        for a, b in itertools.combinations(sorted(ks), 2):
            want[(a, b)] = want.get((a, b), 0) + 1
    want = {p: c for p, c in want.items() if c > 3}
    cands = items.select("k").distinct()
    for most in (10_000, 5):
        got = co_purchase_pairs(items, "o", "k", cands, 3, pairs_per_task=most).collect()
        assert {(r.k1, r.k2): r.common_orders_count for r in got} == want


def test_lead_order_counts_joined_rows(spark):
    t = make_tables(spark, leads=[(1, "b"), (2, "a"), (3, "a")], closed=[(1,)] * 5)
    assert [r.origin for r in R.lead_conversion(t, P).collect()] == ["b", "a"]   # 5 joined rows against 2


def test_city_keys_tell_same_named_cities_apart(spark):
    orders = [order(i, 10 + i % 3, "2017-01-01 00:00:00") for i in range(7)]
    t = make_tables(spark, orders=orders, customers=[(10, 1, "X", 1), (11, 2, "X", 2), (12, 3, "Y", 3)])
    one = [(r.customer_city, r.city_order_count) for r in R.top_cities(t, P).collect()]
    assert one == [("X", 5), ("Y", 2)]
    by_zip = R.Params(**{**P.__dict__, "city_keys": ("city", "zip")})
    two = [(r.customer_city, r.zip, r.city_order_count) for r in R.top_cities(t, by_zip).collect()]
    assert two == [("X", 1, 3), ("X", 2, 2), ("Y", 3, 2)]
    assert R.stage_latency_top_cities(t, by_zip).count() == 3


def test_one_time_and_repeat_customers(spark):
    orders = [order(1, 10, "2017-01-01 00:00:00"), order(2, 10, "2018-01-01 00:00:00"), order(3, 11, "2017-01-01 00:00:00"),
              order(4, 12, "2017-01-01 00:00:00")]
    t = make_tables(spark, orders=orders, customers=[(10, 1, "X", 1), (11, 2, "X", 1), (12, 3, "X", 1)])
    assert {(r.order_type, r.proportion) for r in R.repeat_customer_share(t, P).collect()} == {("repeat", 33.3), ("one-time", 66.7)}


def test_hot_basket_is_split_over_tasks(spark):
    """A basket with a third of all rows: no task of the pair join reads most of it."""
    rows = [(0, k) for k in range(400)] + [(1 + i // 2, i % 40) for i in range(800)]
    items = spark.createDataFrame(rows, "o long, k long")
    n = 400
    parts = items.join(items.selectExpr("k as kk", "o as oo"), F.col("o") == F.col("oo")).where("k < kk").count()
    got = co_purchase_pairs(items, "o", "k", items.select("k").distinct(), 0, pairs_per_task=10_000)
    assert got.selectExpr("sum(common_orders_count)").first()[0] == parts
    left = (items.where("o = 0").groupBy(F.pmod(F.xxhash64("k"), F.lit(-(-n * n // 10_000)))).count().agg(F.max("count")).first()[0])
    assert left * n <= 3 * 10_000


def test_mean_of_means_is_close_to_the_plain_mean(spark):
    from fractions import Fraction

    import random
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 10 ** 13), rnd.randint(1, 999)) for i in range(200)]
    from tradelens.operators.aggregates import mean_of_means
    got = mean_of_means(spark.createDataFrame(rows, "g long, s long, c long"), "s", "c", 86_400_000_000).first()[0]
    exact = sum(Fraction(s, c * 86_400_000_000) for _, s, c in rows) / len(rows)
    plain = sum(s / c / 86_400_000_000 for _, s, c in rows) / len(rows)
    assert abs(got - float(exact)) <= 1e-12 and abs(got - plain) <= 1e-11


def test_fixed_point_means_are_close_to_plain_averages(spark):
    """Spend per order and CLV are averaged in exact units; plain averages of doubles differ by rounding only."""
    from tests.conftest import SF_SMALL
    from tradelens.plans.catalog import TEST_PARAMS, tables_for
    t = tables_for(spark, SF_SMALL)
    people = R.ntile_scores(t, TEST_PARAMS)
    plain = {r.rfm_bucket: r.m for r in people.groupBy("rfm_bucket").agg(F.avg(F.col("total_spent") / F.col("total_orders")).alias("m")).collect()}
    for r in R.rfm_segments(t, TEST_PARAMS).collect():
        assert abs(r.avg_sales_per_customer - plain[r.rfm_bucket]) <= 1e-8 + 1e-12 * abs(plain[r.rfm_bucket])
    clv = R.customer_lifetime_value(t, TEST_PARAMS).select("zip_code_prefix", (F.col("pf") * F.col("aov") * F.col("acl")).alias("v"))
    want = {r.zip_code_prefix: r.m for r in clv.groupBy("zip_code_prefix").agg(F.avg("v").alias("m")).collect()}
    for r in R.clv_by_area(t, TEST_PARAMS).collect():
        assert abs(r.avg_clv - want[r.zip_prefix]) <= 1e-8 + 1e-12 * abs(want[r.zip_prefix])
