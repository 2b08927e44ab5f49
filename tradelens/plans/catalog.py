"""Query registry: every report as ``(spark, sf_dir) -> DataFrame`` on the test star schema.

``TEST_PARAMS`` are the parameters of FIXTURES.md B.4 (thresholds scaled to the
test data); the report functions themselves default to the original values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradelens.plans import reports as R
from tradelens.plans import state as S
from tradelens.sources.sinks import preview
from tradelens.sources.tables import read_table, star_tables

TEST_PARAMS = R.Params(
    delivered="F",
    selected_categories=("brand#1", "brand#2", "brand#3", "brand#4", "brand#5"),
    monthly_since="1999-01-01",
    daily_start="2000-01-01",
    daily_end="2001-08-01",
    forecast_first="2001-12-01",
    forecast_last="2001-12-31",
    forecast_shift_from="2000-12-31",
    regression_days=(0, 577),
    shipping_from="1999-06-01",
    shipping_to="2000-06-30",
    as_of="2001-08-02",
    frequent_min=5,
    pair_min=1,
    seller_item_min=40,
    seller_pair_min=5,
    scorecard_min=620,
    band_edges=(1, 550, 600, 650),
    quarter_start="2001-05-01",
    state_until="2001-07-01",
    state_again_from="2001-06-24",
)

REPORTS: dict[str, Callable] = {
    "orders_per_day": R.orders_per_day,
    "order_time_parts": R.order_time_parts,
    "weekday_hour_matrix": R.weekday_hour_matrix,
    "heat_cells_flagged": R.heat_cells_flagged,
    "top_cities": R.top_cities,
    "top_cities_ascending": R.top_cities_ascending,
    "stage_latency_top_cities": R.stage_latency_top_cities,
    "stage_latency_max_total": R.stage_latency_max_total,
    "order_value_stats": R.order_value_stats,
    "order_cost_split": R.order_cost_split,
    "product_cost_hist": R.product_cost_hist,
    "shipping_cost_hist": R.shipping_cost_hist,
    "ranked_categories": R.ranked_categories,
    "category_sales_summary": R.category_sales_summary,
    "share_of_total": R.share_of_total_report,
    "ordered_weights": R.ordered_weights,
    "category_median_weight": R.category_median_weight,
    "weight_box_stats": R.weight_box_stats,
    "monthly_category_sales": R.monthly_category_sales,
    "daily_category_sales": R.daily_category_sales,
    "category_trend": R.category_trend,
    "fastest_growing": R.fastest_growing,
    "regression_lines": R.regression_lines,
    "december_forecast": R.december_forecast,
    "daily_delivery_time": R.daily_delivery_time,
    "mean_delivery_time": R.mean_delivery_time,
    "review_score_counts": R.review_score_counts,
    "negative_comment_text": R.negative_comment_text,
    "negative_terms": R.negative_terms,
    "ntile_scores": R.ntile_scores,
    "rfm_segments": R.rfm_segments,
    "rfm_bubbles": R.rfm_bubbles,
    "repeat_customer_share": R.repeat_customer_share,
    "customer_lifetime_value": R.customer_lifetime_value,
    "clv_by_area": R.clv_by_area,
    "clv_by_area_raw": R.clv_by_area_raw,
    "clv_bubbles": R.clv_bubbles,
    "clv_popups": R.clv_popups,
    "frequent_products": R.frequent_products,
    "co_purchased_products": R.co_purchased_products,
    "co_sold_sellers": R.co_sold_sellers,
    "affinity_vertices": R.affinity_vertices,
    "affinity_categories": R.affinity_categories,
    "affinity_edges": R.affinity_edges,
    "affinity_nodes_sized": R.affinity_nodes_sized,
    "seller_scorecard": R.seller_scorecard,
    "seller_scorecard_dedup": R.seller_scorecard_dedup,
    "seller_bands": R.seller_bands,
    "sellers_per_band": R.sellers_per_band,
    "delivery_time_by_band": R.delivery_time_by_band,
    "delivery_box_stats": R.delivery_box_stats,
    "lead_conversion": R.lead_conversion,
    "lead_conversion_sketched": R.lead_conversion_sketched,
    "weight_quantiles_sketched": R.weight_quantiles_sketched,
    "top_negative_terms": R.top_negative_terms,
    "monthly_sales_from_state": S.monthly_sales_from_state,
    "quarter_sales_of_monthly_facts": S.quarter_sales_of_monthly_facts,
}


def _table_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(read_table(spark, sf_dir, "orders"), TEST_PARAMS.preview_rows, columns=[0, 1, 2],
                   order_by=["o_orderkey"])


_TABLES: dict[tuple[str, str], object] = {}


def tables_for(spark: SparkSession, sf_dir: str):
    """Canonical tables for one application and directory, built once (frames are lazy and
    immutable, so every report can share them; this saves re-reading Parquet footers)."""
    application = spark.sparkContext.applicationId
    key = (application, sf_dir)
    if key not in _TABLES:
        for other in [k for k in _TABLES if k[0] != application]:  # of a context that has stopped
            del _TABLES[other]
        _TABLES[key] = star_tables(spark, sf_dir)
    return _TABLES[key]


def _bind(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tables_for(spark, sf_dir), TEST_PARAMS)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {"table_preview": _table_preview}
    out.update({k: _bind(f) for k, f in REPORTS.items()})
    return out
