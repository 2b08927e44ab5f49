"""Reusable DataFrame operators."""

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
from tradelens.operators.bands import band_labels, volume_band
from tradelens.operators.distribution import (
    box_stats,
    expand_positions,
    group_median,
    group_quantiles,
    histogram,
    order_statistics,
    quantiles,
    value_counts,
)
from tradelens.operators.ranking import grouped_ntile, ntile_score, prefix_counts, segment_label
from tradelens.operators.text import term_frequency
from tradelens.operators.trend import centered_mean, fit_line, rank_slopes, score_line, seasonal_forecast

__all__ = [
    "affinity_graph", "band_labels", "box_stats", "bubble_scale", "cell_vs_mean",
    "centered_mean", "co_purchase_pairs", "expand_positions", "fit_line", "frequent_items", "group_median",
    "group_quantiles", "grouped_ntile", "histogram", "mean_of_means", "ntile_score", "order_statistics",
    "pivot_measure", "prefix_counts", "quantiles", "rank_slopes", "score_line", "seasonal_forecast", "segment_label",
    "share_of_total", "term_frequency", "top_n", "top_n_with_other", "two_level_stats", "value_counts",
    "volume_band",
]
