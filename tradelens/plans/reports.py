"""Named reports.

Each report is a function ``(tables, params) -> DataFrame``: a lazy plan with no
driver round trip between steps.  Results that feed later steps (top cities,
top categories, frequent items, seller bands) stay DataFrames and are joined,
never collected.

Plan shape, used throughout:
* facts are aggregated to the grain of the next join key *before* joining
  (items per order or product, orders per customer, payments per order), so
  joins see one row per key and partial aggregation absorbs skewed keys;
* filters are plain comparisons on scanned columns, so they reach Parquet;
* no join side is broadcast by a hint: Spark's size statistics and AQE decide (a broadcast for
  sides that turn out small, else sort-merge with skew-partition splitting for hot keys);
* money is summed as ``decimal(18,2)`` and cast to double at the end; means are
  exact sums divided once.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.numeric import mean_of_units, ratio_units, round_ratio, safe_div
from tradelens.functions.timecols import (
    MICROS_PER_DAY,
    between_half_open,
    day_index,
    elapsed_days,
    elapsed_micros,
    mean_days,
    shift_year,
    ts_literal,
    weekday_label,
    weekday_number,
    year_month,
)
from tradelens.operators.affinity import affinity_graph, co_purchase_pairs, frequent_items
from tradelens.operators.aggregates import (
    bubble_scale,
    cell_vs_mean,
    mean_of_means,
    pivot_measure,
    share_of_total,
    top_n,
    top_n_with_other,
    two_level_stats,
)
from tradelens.operators.bands import volume_band
from tradelens.operators.distribution import box_stats, expand_positions, group_median, histogram
from tradelens.operators.keys import dealt_by
from tradelens.operators.ranking import grouped_ntile, segment_label
from tradelens.operators.sketches import (
    common_count,
    distinct_count,
    distinct_states,
    merged_distinct,
    merged_quantiles,
    quantile_states,
)
from tradelens.operators.text import term_frequency, top_terms
from tradelens.operators.trend import centered_mean, fit_line, rank_slopes, score_line, seasonal_forecast
from tradelens.session import cut_lineage
from tradelens.sources.tables import Tables


@dataclass(frozen=True)
class Params:
    """Report parameters; defaults are the values of the original analysis."""

    delivered: str = "delivered"
    top_cities: int = 10
    top_categories: int = 18
    other_label: str = "Other categories"
    selected_categories: tuple = ("health_beauty", "auto", "toys", "electronics", "fashion_shoes")
    monthly_since: str = "2017-01-01"
    daily_start: str = "2017-01-01"          # also day 0 of the day index
    daily_end: str = "2018-08-29"            # exclusive
    forecast_first: str = "2018-12-01"
    forecast_last: str = "2018-12-31"
    forecast_shift_from: str = "2017-12-31"  # shift = forecast_last - forecast_shift_from (days)
    regression_days: tuple = (0, 603)
    shipping_from: str = "2017-06-01"
    shipping_to: str = "2018-06-30"          # exclusive
    negative_scores: tuple = (1, 2)
    as_of: str | None = None                 # RFM reference time; required
    acl_floor_days: int = 7
    frequent_min: int = 5
    pair_min: int = 5                        # products, in common orders
    seller_item_min: int = 5
    seller_pair_min: int = 5
    city_keys: tuple = ("city",)             # columns that tell cities apart, the name first
    scorecard_min: int = 10
    band_edges: tuple = (1, 10, 100, 1000)
    approximate_distinct: bool = False       # HyperLogLog counts instead of exact distinct counts
    product_bins: int = 1000
    shipping_bins: int = 800
    preview_rows: int = 5
    top_terms: int = 50
    quarter_start: str = "2018-06-01"        # of facts stored by month, up to daily_end
    state_until: str = "2018-08-01"          # first build of the daily state, exclusive
    state_again_from: str = "2018-07-25"     # the refresh after it


UNITS = 10 ** 8          # fixed-point scale of per-row values that are then averaged


def _days_between(a: str, b: str) -> int:
    return (dt.date.fromisoformat(b) - dt.date.fromisoformat(a)).days


def column_name(label: str) -> str:
    """A safe column name for a data label ('brand#1' -> 'brand_1')."""
    return re.sub(r"[^0-9A-Za-z_]", "_", label)


# ---------------------------------------------------------------------------
# Orders over time
# ---------------------------------------------------------------------------

def orders_per_day(t: Tables, p: Params) -> DataFrame:
    d = F.to_date("purchased")
    return (t.orders.groupBy(d.alias("_d")).agg(F.count(F.lit(1)).alias("order_count"))
            .select(F.date_format("_d", "yyyy-MM-dd").alias("day"), "order_count"))


def order_time_parts(t: Tables, p: Params) -> DataFrame:
    return t.orders.select(
        "order_id", weekday_label("purchased").alias("day_of_week_name"),
        weekday_number("purchased").cast("long").alias("day_of_week_int"),
        F.hour("purchased").cast("long").alias("hour"))


HOUR_COLUMNS = [f"h{h:02d}" for h in range(24)]


def weekday_hour_matrix(t: Tables, p: Params) -> DataFrame:
    parts = order_time_parts(t, p)
    wide = pivot_measure(parts, ["day_of_week_int", "day_of_week_name"], "hour", list(range(24)),
                         HOUR_COLUMNS, how="count")
    return wide.orderBy("day_of_week_int")   # seven rows, Sunday first


def heat_cells_flagged(t: Tables, p: Params) -> DataFrame:
    """Long form of the 7x24 matrix with every cell present, flagged against the grand cell mean."""
    counts = t.orders.groupBy(weekday_number("purchased").cast("long").alias("day_of_week_int"),
                              F.hour("purchased").cast("long").alias("hour")).agg(
        F.count(F.lit(1)).alias("order_count"))
    grid = t.orders.sparkSession.range(7 * 24).select(
        F.floor(F.col("id") / 24).cast("long").alias("day_of_week_int"), (F.col("id") % 24).alias("hour"))
    cells = grid.join(counts, ["day_of_week_int", "hour"], "left").select(
        "day_of_week_int", "hour", F.coalesce("order_count", F.lit(0)).cast("long").alias("order_count"))
    return cell_vs_mean(cells, "order_count")


# ---------------------------------------------------------------------------
# Cities (R05, R06, R17)
# ---------------------------------------------------------------------------

def _city_counts(t: Tables, p: Params) -> DataFrame:
    keys = list(p.city_keys)
    per_customer = t.orders.groupBy("customer_id").agg(F.count("order_id").alias("_n"))
    return (per_customer.join(t.customers.select("customer_id", *keys), "customer_id")
            .groupBy(*keys).agg(F.sum("_n").alias("city_order_count")))


def top_cities(t: Tables, p: Params) -> DataFrame:
    """Cities with the most orders; further ``city_keys`` keep same-named cities apart and are returned."""
    name, *others = p.city_keys
    counts = _city_counts(t, p).select(F.col(name).alias("customer_city"), F.upper(name).alias("city"), *others,
                                       "city_order_count")
    return top_n(counts, "city_order_count", p.top_cities, tie_break=["customer_city", *others])


def top_cities_ascending(t: Tables, p: Params) -> DataFrame:
    return top_cities(t, p).orderBy("city_order_count", F.desc("customer_city"))


STAGES = [("approved", "purchased", "approved"), ("delivered_to_carrier", "approved", "to_carrier"),
          ("delivered_to_customer", "to_carrier", "delivered"), ("estimated_delivery", "delivered", "estimated")]


def stage_latency_top_cities(t: Tables, p: Params) -> DataFrame:
    """Mean fractional days of each order stage for the top cities (each mean skips its own NULLs)."""
    name, *others = p.city_keys
    top = top_cities(t, p).select(F.col("customer_city").alias(name), *others)
    customers = t.customers.select("customer_id", *p.city_keys).join(top, list(p.city_keys), "left_semi")
    rows = t.orders.join(customers, "customer_id")
    out = rows.groupBy(*p.city_keys).agg(*[mean_days(elapsed_micros(a, b)).alias(n) for n, a, b in STAGES])
    out = out.select(F.upper(name).alias("city"), *others, *[n for n, _, _ in STAGES])
    return out.orderBy(F.desc(F.col("approved") + F.col("delivered_to_carrier") + F.col("delivered_to_customer")))


def stage_latency_max_total(t: Tables, p: Params) -> DataFrame:
    """Largest row total of the four stage means (NULL means count as 0)."""
    total = None
    for name, _, _ in STAGES:
        term = F.coalesce(F.col(name), F.lit(0.0))
        total = term if total is None else total + term
    return stage_latency_top_cities(t, p).agg(F.max(total).alias("max_row_total"))


# ---------------------------------------------------------------------------
# Order value
# ---------------------------------------------------------------------------

def order_value_stats(t: Tables, p: Params) -> DataFrame:
    items = t.items.join(t.orders.select("order_id"), "order_id", "left_semi")
    return two_level_stats(items, "order_id", F.col("price") + F.col("freight")).select(
        F.col("min_value").alias("min_order_price"), F.col("avg_value").alias("avg_order_price"),
        F.col("max_value").alias("max_order_price"))


def _delivered_orders(t: Tables, p: Params) -> DataFrame:
    return t.orders.filter(F.col("status") == p.delivered)


def order_cost_split(t: Tables, p: Params) -> DataFrame:
    per_order = t.items.groupBy("order_id").agg(F.sum("price").alias("_pc"), F.sum("freight").alias("_sc"))
    per_order = per_order.join(_delivered_orders(t, p).select("order_id"), "order_id", "left_semi")
    return per_order.select("order_id", F.col("_pc").cast("double").alias("product_cost"),
                            F.col("_sc").cast("double").alias("shipping_cost"))


def product_cost_hist(t: Tables, p: Params) -> DataFrame:
    return histogram(order_cost_split(t, p), "product_cost", p.product_bins)


def shipping_cost_hist(t: Tables, p: Params) -> DataFrame:
    return histogram(order_cost_split(t, p), "shipping_cost", p.shipping_bins)


# ---------------------------------------------------------------------------
# Categories
# ---------------------------------------------------------------------------

def _named_products(t: Tables) -> DataFrame:
    """Products with a translated category (untranslated and NULL categories drop out)."""
    return t.products.join(t.category_names, "category_code").select("product_id", "category", "weight_g")


def _category_sales(t: Tables, p: Params) -> DataFrame:
    delivered_items = t.items.join(_delivered_orders(t, p).select("order_id"), "order_id", "left_semi")
    per_product = delivered_items.groupBy("product_id").agg(F.sum("price").alias("_s"))
    per_category = (per_product.join(_named_products(t), "product_id")
                    .groupBy("category").agg(F.sum("_s").alias("sales")))
    # one row per category: the global rank window runs over the category list only
    return per_category.withColumn("rank", F.rank().over(Window.orderBy(F.desc("sales"))).cast("long"))


def ranked_categories(t: Tables, p: Params) -> DataFrame:
    return _category_sales(t, p).select("category", F.col("sales").cast("double").alias("sales"), "rank")


def _category_summary(t: Tables, p: Params) -> DataFrame:
    return top_n_with_other(_category_sales(t, p), "category", "sales", "rank", p.top_categories, p.other_label)


def category_sales_summary(t: Tables, p: Params) -> DataFrame:
    return _category_summary(t, p).select("category", F.col("sales").cast("double").alias("sales"))


def share_of_total_report(t: Tables, p: Params) -> DataFrame:
    return share_of_total(_category_summary(t, p), "sales").select(
        "category", F.col("sales").cast("double").alias("sales"), "share")


def _top_category_weights(t: Tables, p: Params) -> DataFrame:
    """``category, weight, items``: items sold per top category and weight (no status filter).  Items are
    counted per product before products are looked up."""
    top = _category_sales(t, p).filter(F.col("rank") <= p.top_categories).select("category")
    per_product = t.items.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
    return (per_product.join(_named_products(t).join(top, "category", "left_semi"), "product_id")
            .groupBy("category", F.col("weight_g").alias("weight")).agg(F.sum("_n").alias("items")))


def ordered_weights(t: Tables, p: Params) -> DataFrame:
    """Every item of a top category numbered by weight inside its category (NULL weights first)."""
    rows = expand_positions(_top_category_weights(t, p), ["category"], "weight", "items", out="category_row_n",
                            total="category_count")
    return rows.select("weight", "category", "category_row_n", "category_count")


def category_median_weight(t: Tables, p: Params) -> DataFrame:
    med = group_median(_top_category_weights(t, p), ["category"], "weight", nulls="lowest", out="median_weight", count="items")
    return med.orderBy(F.col("median_weight").asc_nulls_first(), "category")


def weight_box_stats(t: Tables, p: Params) -> DataFrame:
    return box_stats(_top_category_weights(t, p), ["category"], "weight", count="items")


def weight_states(t: Tables, p: Params) -> DataFrame:
    """``category, month, n, sketch``: quantile sketches of the weights of the items sold, to be stored and merged."""
    items = t.items.select("order_id", "product_id").join(_named_products(t), "product_id")
    rows = items.join(t.orders.select("order_id", year_month("purchased").alias("month")), "order_id")
    return quantile_states(rows, ["category", "month"], "weight_g")


def weight_quantiles_sketched(t: Tables, p: Params) -> DataFrame:
    """Quartiles of the item weights per category from merged monthly sketches (ranks within ``rank_error()``)."""
    return merged_quantiles(weight_states(t, p), ["category"], {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(
        "category", F.col("n").alias("item_count"), "q1", "median", "q3")


# ---------------------------------------------------------------------------
# Category trends and forecast
# ---------------------------------------------------------------------------

def _selected_products(t: Tables, p: Params) -> DataFrame:
    # the filtered dimension is small, but its size is the dimension's: Spark's statistics decide
    names = t.category_names.filter(F.col("category").isin(list(p.selected_categories)))
    return t.products.join(names, "category_code").select("product_id", "category")


def _selected_items(t: Tables, p: Params) -> DataFrame:
    """``order_id, category, price``: products are looked up first, so only items of selected categories meet
    the orders."""
    return t.items.select("order_id", "product_id", "price").join(_selected_products(t, p), "product_id").select(
        "order_id", "category", "price")


def monthly_category_sales(t: Tables, p: Params) -> DataFrame:
    orders = t.orders.filter(between_half_open("purchased", lo=p.monthly_since)).select("order_id", "purchased")
    rows = _selected_items(t, p).join(orders, "order_id")
    cats = list(p.selected_categories)
    wide = pivot_measure(rows.withColumn("year_month", year_month("purchased")), ["year_month"], "category",
                         cats, [column_name(c) for c in cats], how="sum", measure="price")
    return wide.select("year_month", *[F.col(column_name(c)).cast("double").alias(column_name(c)) for c in cats])


def _daily_category_sales(t: Tables, p: Params) -> DataFrame:
    orders = t.orders.filter(between_half_open("purchased", p.daily_start, p.daily_end)).select(
        "order_id", "purchased")
    rows = _selected_items(t, p).join(orders, "order_id")
    return rows.groupBy(day_index("purchased", p.daily_start).cast("long").alias("day"), "category").agg(
        F.sum("price").alias("sales"))


def daily_category_sales(t: Tables, p: Params) -> DataFrame:
    origin = F.to_date(F.lit(p.daily_start))
    return _daily_category_sales(t, p).select(
        F.date_format(F.date_add(origin, F.col("day").cast("int")), "yyyy-MM-dd").alias("date"), "day",
        "category", F.col("sales").cast("double").alias("sales"))


def category_trend(t: Tables, p: Params) -> DataFrame:
    return fit_line(_daily_category_sales(t, p), ["category"], "day", "sales")


def fastest_growing(t: Tables, p: Params) -> DataFrame:
    return rank_slopes(category_trend(t, p))


def regression_lines(t: Tables, p: Params) -> DataFrame:
    lo, hi = p.regression_days
    return score_line(category_trend(t, p), ["category"], lo, hi)


def december_forecast(t: Tables, p: Params) -> DataFrame:
    """Sales a year back scaled by the fitted growth, then a centred 5-row mean per category."""
    shift = _days_between(p.forecast_shift_from, p.forecast_last)
    lo = _days_between(p.daily_start, p.forecast_first)
    hi = _days_between(p.daily_start, p.forecast_last)
    daily = cut_lineage(_daily_category_sales(t, p))  # one row per day and category, read by model and forecast
    model = fit_line(daily, ["category"], "day", "sales")
    fc = seasonal_forecast(daily, model, ["category"], "day", "sales", shift, lo, hi)
    origin = F.to_date(F.lit(p.daily_start))
    fc = fc.withColumn("_date", shift_year(F.date_add(origin, F.col("day").cast("int"))))
    out = centered_mean(fc, ["category"], "_date", "forecast", 2, 2, out="moving_avg_sales")
    return out.select(F.dayofmonth("_date").cast("long").alias("december_day"), "category", "moving_avg_sales")


# ---------------------------------------------------------------------------
# Delivery (R18, O10)
# ---------------------------------------------------------------------------

def daily_delivery_time(t: Tables, p: Params) -> DataFrame:
    orders = t.orders.filter(between_half_open("purchased", p.shipping_from, p.shipping_to))
    return (orders.groupBy(F.to_date("purchased").alias("_d"))
            .agg(mean_days(elapsed_micros("purchased", "delivered")).alias("avg_delivery_time"))
            .select(F.date_format("_d", "yyyy-MM-dd").alias("purchase_date"), "avg_delivery_time"))


def mean_delivery_time(t: Tables, p: Params) -> DataFrame:
    """Unweighted mean of the daily means."""
    orders = t.orders.filter(between_half_open("purchased", p.shipping_from, p.shipping_to))
    us = elapsed_micros("purchased", "delivered")
    daily = orders.groupBy(F.to_date("purchased").alias("_d")).agg(F.sum(us).alias("_s"), F.count(us).alias("_c"))
    return mean_of_means(daily, "_s", "_c", MICROS_PER_DAY, out="mean_delivery_time")


# ---------------------------------------------------------------------------
# Reviews (R19, R20, O18)
# ---------------------------------------------------------------------------

def review_score_counts(t: Tables, p: Params) -> DataFrame:
    return t.reviews.groupBy(F.col("score").cast("long").alias("review_score")).agg(
        F.count(F.lit(1)).alias("review_count"))


def _negative_comments(t: Tables, p: Params) -> DataFrame:
    return t.comments.filter(F.col("score").isin(list(p.negative_scores)) & F.col("comment").isNotNull())


def negative_comment_text(t: Tables, p: Params) -> DataFrame:
    """The negative comments, whole, one row each with its review id.

    The original joins them into one string; a single value built from every
    comment would sit in one task, so the text stays row-wise (write it with
    ``write_text_lines(..., order_by=["review_id"])`` to get the one document).
    """
    return _negative_comments(t, p).select("review_id", F.col("score").cast("long").alias("score"), "comment")


def negative_terms(t: Tables, p: Params) -> DataFrame:
    return term_frequency(_negative_comments(t, p), "comment")


def top_negative_terms(t: Tables, p: Params) -> DataFrame:
    """The most frequent words of the negative comments, without counting all others."""
    return top_terms(_negative_comments(t, p), "comment", p.top_terms)


# ---------------------------------------------------------------------------
# Customers
# ---------------------------------------------------------------------------

def _rfm_people(t: Tables, p: Params) -> DataFrame:
    if p.as_of is None:
        raise ValueError("RFM needs an explicit as_of time")
    delivered = _delivered_orders(t, p).select("order_id", "customer_id", "purchased").join(
        t.customers.select("customer_id", "person_id"), "customer_id")
    rf = delivered.groupBy("person_id").agg(F.max("purchased").alias("last_purchase"),
                                            F.count("order_id").alias("total_orders"))
    spend = (t.items.groupBy("order_id").agg(F.sum("price").alias("_s"))
             .join(delivered.select("order_id", "person_id"), "order_id")
             .groupBy("person_id").agg(F.sum("_s").alias("total_spent")))
    # The three scores are one partitioned NTILE over a long table (metric, person, value):
    # one pass, no self join of score tables.  Values share an exact decimal type;
    # recency orders by the purchase time in microseconds.
    metric_value = "decimal(38,2)"
    last_us = elapsed_micros(ts_literal("1970-01-01"), F.col("last_purchase"))
    no_time = F.lit(None).cast("timestamp_ntz")
    # recency and frequency rows come from one pass over rf (an explode, not a second scan)
    rf_rows = rf.select("person_id", F.explode(F.array(
        F.struct(F.lit("recency").alias("metric"), last_us.cast(metric_value).alias("v"),
                 F.col("last_purchase").alias("_lp")),
        F.struct(F.lit("frequency").alias("metric"), F.col("total_orders").cast(metric_value).alias("v"),
                 no_time.alias("_lp")))).alias("_m")).select("person_id", "_m.*")
    long = rf_rows.unionByName(spend.select("person_id", F.lit("monetary").alias("metric"),
                                            F.col("total_spent").cast(metric_value).alias("v"),
                                            no_time.alias("_lp")))
    tiles = grouped_ntile(long, ["metric"], "v", 5, "person_id", descending=True, out="tile")
    metrics = ("recency", "frequency", "monetary")
    people = tiles.groupBy("person_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("tile"))).alias(m) for m in metrics],
        *[F.max(F.when(F.col("metric") == m, F.col("v"))).alias(f"_v_{m}") for m in metrics],
        F.max("_lp").alias("last_purchase"))
    # a person needs all three scores (monetary exists only for people with items)
    people = people.filter(F.col("monetary").isNotNull() & F.col("recency").isNotNull()).select(
        "person_id", "recency", "frequency", "monetary",
        "last_purchase",
        F.col("_v_frequency").cast("long").alias("total_orders"),
        F.col("_v_monetary").cast("decimal(28,2)").alias("total_spent"))
    return people.withColumn("rfm_bucket", segment_label("recency", "frequency", "monetary"))


def ntile_scores(t: Tables, p: Params) -> DataFrame:
    return _rfm_people(t, p).select(
        "person_id", "total_orders", F.col("total_spent").cast("double").alias("total_spent"),
        F.col("recency").cast("long").alias("recency"), F.col("frequency").cast("long").alias("frequency"),
        F.col("monetary").cast("long").alias("monetary"), "rfm_bucket")


def rfm_segments(t: Tables, p: Params) -> DataFrame:
    people = _rfm_people(t, p)
    return people.groupBy("rfm_bucket").agg(
        mean_days(elapsed_micros(F.col("last_purchase"), ts_literal(p.as_of))).alias("avg_days_since_purchase"),
        # per-person spend per order in exact 1e-8 units, so the mean does not depend on task order
        mean_of_units(ratio_units("total_spent", "total_orders", UNITS), UNITS).alias("avg_sales_per_customer"),
        F.count(F.lit(1)).alias("customer_count"))


def rfm_bubbles(t: Tables, p: Params, size_factor: float = 0.55) -> DataFrame:
    """RFM segments with the scatter marker size (``size_factor * customer_count``)."""
    return rfm_segments(t, p).withColumn(
        "marker_size", F.lit(size_factor) * F.col("customer_count").cast("double"))


def repeat_customer_share(t: Tables, p: Params) -> DataFrame:
    per_customer = t.orders.groupBy("customer_id").agg(F.count("order_id").alias("_n"))
    per_person = (per_customer.join(t.customers.select("customer_id", "person_id"), "customer_id")
                  .groupBy("person_id").agg(F.sum("_n").alias("_n")))
    kinds = per_person.groupBy(
        F.when(F.col("_n") > 1, "repeat").otherwise("one-time").alias("order_type")).agg(
        F.count(F.lit(1)).alias("_people"))
    # at most two rows: the window over all of them is tiny
    total = F.sum("_people").over(Window.partitionBy())
    return kinds.select("order_type", round_ratio(F.col("_people") * 100, total, 1).alias("proportion"))


def _clv_people(t: Tables, p: Params) -> DataFrame:
    per_order = t.payments.groupBy("order_id").agg(F.sum("payment").alias("_pay"))
    rows = (per_order.join(t.orders.select("order_id", "customer_id", "purchased"), "order_id")
            .join(t.customers.select("customer_id", "person_id", "zip"), "customer_id"))
    people = rows.groupBy("person_id").agg(
        F.count("order_id").alias("pf"), F.sum("_pay").alias("_total"),
        F.min("purchased").alias("_first"), F.max("purchased").alias("_last"),
        F.max(F.struct("purchased", "zip")).getField("zip").alias("zip"))
    span = elapsed_micros("_first", "_last")
    floor_us = p.acl_floor_days * MICROS_PER_DAY
    acl = F.when(span < floor_us, F.lit(1.0)).otherwise(
        span.cast("double") / F.lit(float(MICROS_PER_DAY)) / F.lit(float(p.acl_floor_days)))
    # CLV = PF x AOV x ACL = total x ACL, also as exact 1e-8 units for averaging
    cents = (F.col("_total") * 100).cast("decimal(38,0)")
    week_us = p.acl_floor_days * MICROS_PER_DAY
    clv_units = F.when(span < floor_us, cents * F.lit(UNITS // 100)).otherwise(
        ratio_units(cents * span, F.lit(week_us // (UNITS // 100)), 1))
    return people.select("person_id", "zip", "pf", safe_div("_total", "pf").alias("aov"), acl.alias("acl"),
                         clv_units.alias("_clv_units"))


def customer_lifetime_value(t: Tables, p: Params) -> DataFrame:
    return _clv_people(t, p).select("person_id", F.col("zip").alias("zip_code_prefix"), "pf", "aov", "acl")


def clv_by_area(t: Tables, p: Params, raw_fanout: bool = False) -> DataFrame:
    """Mean CLV per zip prefix with the zip's mean coordinates.

    CLV is aggregated per zip before the join, and coordinates are averaged per
    zip first, so several points per zip neither multiply customers nor pick
    an arbitrary point.  ``raw_fanout=True`` reproduces the original's
    customer count, which counts every (customer, geo point) pair; it is
    computed as customers x points, without building the pairs.
    """
    clv = _clv_people(t, p).select("person_id", "zip", "_clv_units")
    per_zip = clv.groupBy("zip").agg(F.sum("_clv_units").alias("_su"), F.count("_clv_units").alias("_nu"),
                                     F.count("person_id").alias("customer_count"))
    geo = t.geo.groupBy("zip").agg(F.sum("lat").alias("_slat"), F.count("lat").alias("_nlat"),
                                   F.sum("lng").alias("_slng"), F.count("lng").alias("_nlng"),
                                   F.count(F.lit(1)).alias("_points"))
    # every mean is an exact sum over an exact count; in fan-out mode both are taken over the
    # (customer, point) pairs, i.e. multiplied by the other side's count
    k_geo = F.col("_points") if raw_fanout else F.lit(1)
    k_cust = F.col("customer_count") if raw_fanout else F.lit(1)

    def mean(total, n, k, scale=1):
        return F.try_divide(safe_div(F.col(total) * k, F.col(n) * k), F.lit(float(scale)))
    count = F.col("customer_count") * F.col("_points") if raw_fanout else F.col("customer_count")
    return per_zip.join(geo, "zip").select(
        F.col("zip").alias("zip_prefix"), mean("_su", "_nu", k_geo, UNITS).alias("avg_clv"),
        count.alias("customer_count"), mean("_slat", "_nlat", k_cust).alias("latitude"),
        mean("_slng", "_nlng", k_cust).alias("longitude"))


def clv_by_area_raw(t: Tables, p: Params) -> DataFrame:
    return clv_by_area(t, p, raw_fanout=True)


def clv_bubbles(t: Tables, p: Params) -> DataFrame:
    return bubble_scale(clv_by_area(t, p), "customer_count", "avg_clv")


def clv_popups(t: Tables, p: Params) -> DataFrame:
    """Map popups: a line of text per zip prefix (F23), and the customer count on a log axis."""
    area = clv_by_area(t, p).select("zip_prefix", "customer_count")
    text = F.concat(F.lit("Zip "), F.col("zip_prefix").cast("string"), F.lit(": "),
                    F.col("customer_count").cast("string"), F.lit(" customers"))
    return area.select("zip_prefix", text.alias("popup"), F.round(F.log10("customer_count"), 9).alias("log_customers"))


# ---------------------------------------------------------------------------
# Product affinity
# ---------------------------------------------------------------------------

def frequent_products(t: Tables, p: Params) -> DataFrame:
    counts = frequent_items(t.items, "product_id", "order_id", p.frequent_min, out="orders_count")
    return counts.join(_named_products(t).select("product_id", "category"), "product_id").select(
        "product_id", "category", "orders_count")


def co_purchased_products(t: Tables, p: Params) -> DataFrame:
    return co_purchase_pairs(t.items, "order_id", "product_id", frequent_products(t, p), p.pair_min)


def co_sold_sellers(t: Tables, p: Params) -> DataFrame:
    """Pairs of frequent sellers with orders in common."""
    frequent = frequent_items(t.items, "seller_id", "order_id", p.seller_item_min)
    return co_purchase_pairs(t.items, "order_id", "seller_id", frequent, p.seller_pair_min)


def affinity_vertices(t: Tables, p: Params) -> DataFrame:
    """Products with a partner: category, item count, degree and weighted degree."""
    products = frequent_products(t, p).withColumnRenamed("orders_count", "item_count")
    vertices, _ = affinity_graph(products, co_purchased_products(t, p), "product_id", "common_orders_count")
    return vertices


def affinity_categories(t: Tables, p: Params) -> DataFrame:
    """Categories of the products that stay in the graph, with their number of products."""
    return affinity_vertices(t, p).groupBy("category").agg(F.count(F.lit(1)).alias("product_count"))


def affinity_nodes_sized(t: Tables, p: Params, size_factor: float = 5.0) -> DataFrame:
    """Graph vertices with the node size (``size_factor * item_count``)."""
    return affinity_vertices(t, p).withColumn(
        "node_size", F.lit(size_factor) * F.col("item_count").cast("double"))


def affinity_edges(t: Tables, p: Params) -> DataFrame:
    products = frequent_products(t, p).withColumnRenamed("orders_count", "item_count")
    _, edges = affinity_graph(products, co_purchased_products(t, p), "product_id", "common_orders_count")
    return edges


# ---------------------------------------------------------------------------
# Sellers (R27-R30)
# ---------------------------------------------------------------------------

def _review_per_order(t: Tables) -> DataFrame:
    return t.reviews.groupBy("order_id").agg(F.count(F.lit(1)).alias("_r"), F.sum("score").alias("_ss"),
                                             F.count("score").alias("_ns"))


def seller_scorecard(t: Tables, p: Params) -> DataFrame:
    """Faithful scorecard: item rows x review rows, as left joins produce them.

    The fan-out is computed arithmetically (each item row counts once per review
    of its order, at least once) instead of materialising the joined rows.
    """
    orders = t.orders.select("order_id").join(_review_per_order(t), "order_id", "left").withColumn(
        "_ok", F.lit(True))
    rows = t.items.select("seller_id", "order_id", "price").join(orders, "order_id", "left")
    mult = F.when(F.col("_ok").isNull(), F.lit(1)).otherwise(F.greatest(F.coalesce("_r", F.lit(0)), F.lit(1)))
    per_seller = rows.groupBy("seller_id").agg(
        F.sum("_ss").alias("_ss"), F.sum("_ns").alias("_ns"),
        F.sum(F.col("price") * mult).alias("_sales"),
        F.sum(F.when(F.col("_ok").isNotNull(), mult).otherwise(0)).alias("num_orders"))
    out = t.sellers.join(per_seller, "seller_id", "left").filter(
        F.coalesce(F.col("num_orders"), F.lit(0)) > p.scorecard_min)
    return out.select("seller_id", safe_div("_ss", "_ns").alias("avg_review_score"),
                      F.col("_sales").cast("double").alias("total_sales"), "num_orders")


def seller_scorecard_dedup(t: Tables, p: Params) -> DataFrame:
    """Scorecard without fan-out: sales once per item, each order's reviews once per seller.

    Kept sellers have more than ``scorecard_min`` item rows on existing orders.  An order's items lie together, sorted by
    seller; the first of each seller carries the order and its reviews, so no table of (seller, order) is held.
    """
    in_order = Window.partitionBy("order_id").orderBy("seller_id")
    items = (dealt_by(t.items.select("seller_id", "order_id", "price"), "order_id")
             .withColumn("_first", (F.row_number().over(in_order) == 1) | ~F.lag("seller_id").over(in_order).eqNullSafe(F.col("seller_id")))
             .join(t.orders.select("order_id"), "order_id", "left_semi"))
    rows = items.join(_review_per_order(t), "order_id", "left")
    first = F.col("_first")
    cards = rows.groupBy("seller_id").agg(
        F.sum("price").alias("_sales"), F.count(F.lit(1)).alias("_items"), F.count(F.when(first, F.lit(1))).alias("num_orders"),
        F.sum(F.when(first, F.col("_ss"))).alias("_ss"), F.sum(F.when(first, F.col("_ns"))).alias("_ns"))
    out = t.sellers.join(cards, "seller_id").filter(F.col("_items") > p.scorecard_min)
    return out.select("seller_id", safe_div("_ss", "_ns").alias("avg_review_score"),
                      F.col("_sales").cast("double").alias("total_sales"), "num_orders")


def seller_bands(t: Tables, p: Params) -> DataFrame:
    counts = t.items.groupBy("seller_id").agg(F.count("order_id").alias("_n"))
    return counts.select("seller_id", volume_band("_n", list(p.band_edges)).alias("bucket"))


def sellers_per_band(t: Tables, p: Params) -> DataFrame:
    return seller_bands(t, p).groupBy("bucket").agg(F.count("seller_id").alias("seller_count"))


def _delivered_items(t: Tables, p: Params) -> DataFrame:
    delivered = _delivered_orders(t, p).select("order_id", elapsed_days("purchased", "delivered").alias("delivery_time"))
    return t.items.select("order_id", "seller_id").join(delivered, "order_id")


def delivery_time_by_band(t: Tables, p: Params) -> DataFrame:
    rows = _delivered_items(t, p).join(seller_bands(t, p), "seller_id")
    return rows.select("bucket", "seller_id", "delivery_time")


def delivery_box_stats(t: Tables, p: Params) -> DataFrame:
    # items are counted per seller and delivery time before sellers get their band
    counts = _delivered_items(t, p).groupBy("seller_id", "delivery_time").agg(F.count(F.lit(1)).alias("_n"))
    return box_stats(counts.join(seller_bands(t, p), "seller_id"), ["bucket"], "delivery_time", count="_n")


# ---------------------------------------------------------------------------
# Leads (R31)
# ---------------------------------------------------------------------------

def lead_conversion(t: Tables, p: Params) -> DataFrame:
    """Leads by origin; the origin with the most rows of leads joined to closures comes first."""
    closed = t.closed.groupBy("lead_id").agg(F.count(F.lit(1)).alias("_closures"))
    rows = t.leads.join(closed, "lead_id", "left")
    distinct = F.approx_count_distinct if p.approximate_distinct else F.count_distinct
    out = rows.groupBy(F.coalesce(F.col("origin"), F.lit("unknown")).alias("origin")).agg(
        distinct("lead_id").alias("qualified_leads"),
        distinct(F.when(F.col("_closures").isNotNull(), F.col("lead_id"))).alias("closed_leads"),
        # a lead counts once for each of its closures, and once without any
        F.sum(F.when(F.col("lead_id").isNotNull(), F.coalesce("_closures", F.lit(1)))).alias("_rows"))
    return out.orderBy(F.desc_nulls_last("_rows"), "origin").select(
        "origin", "qualified_leads", "closed_leads",
        safe_div(F.col("closed_leads").cast("double") * 100.0, "qualified_leads").alias("conversion_rate"))


def lead_states(t: Tables, p: Params) -> tuple[DataFrame, DataFrame]:
    """``origin, sketch`` of the leads and ``sketch`` of the closed ones: states that can be stored and merged."""
    leads = t.leads.select(F.coalesce(F.col("origin"), F.lit("unknown")).alias("origin"), "lead_id")
    return distinct_states(leads, ["origin"], "lead_id"), distinct_states(t.closed, [], "lead_id")


def lead_conversion_sketched(t: Tables, p: Params) -> DataFrame:
    """Leads and closed leads by origin, and over all origins, from distinct sketches and their intersections."""
    leads, closed = lead_states(t, p)
    every = merged_distinct(leads, []).select(F.lit("all origins").alias("origin"), "sketch")
    both = leads.unionByName(every).withColumn("won", closed.select("sketch").scalar())
    counted = both.select("origin", distinct_count("sketch").alias("qualified_leads"),
                          common_count("sketch", "won").alias("closed_leads"))
    return counted.select("*", safe_div(F.col("closed_leads").cast("double") * 100.0, "qualified_leads").alias("conversion_rate"))
