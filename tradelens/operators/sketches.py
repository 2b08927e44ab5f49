"""Mergeable sketches that are stored per part of the data and merged without reading rows again.

Both are binary columns of a state table, one row per key (for instance category and day): append the states of a new
day, merge the states of any set of days.  Exact operators remain the default; these are for groups and spans too
large to read again.

* Quantiles: KLL sketches.  An estimate's rank is within ``rank_error(k)`` of the asked one (99 % confidence) whatever the
  number of rows and merges; groups of fewer than ``k`` rows are exact.
* Distinct values: theta sketches, which can be intersected.  Up to ``2**lg`` values they are exact; beyond, the relative
  standard error is ``2**(-lg / 2)``, and that of an intersection grows with the root of union over intersection.

NULL values take no part; a state of no values has a sketch of none, and NULL estimates of its quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILE_K = 800
DISTINCT_LG = 14


def rank_error(k: int = QUANTILE_K) -> float:
    """Normalised rank error of one quantile of a KLL sketch at 99 % confidence (the sketch library's formula)."""
    return 2.296 / k ** 0.9021


def quantile_states(df: DataFrame, keys: Sequence[str], value: str, k: int = QUANTILE_K) -> DataFrame:
    """``keys, n, sketch``: a quantile sketch of ``value`` per group."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.kll_sketch_agg_double(v, k).alias("sketch"))


def merged_quantiles(states: DataFrame, keys: Sequence[str], probs: dict[str, float], k: int = QUANTILE_K) -> DataFrame:
    """``keys, n`` and a column per entry of ``probs``, from the merged states of each group."""
    merged = states.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return merged.select(*keys, "n", *[
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(name) for name, p in probs.items()])


def distinct_states(df: DataFrame, keys: Sequence[str], value: str, lg: int = DISTINCT_LG) -> DataFrame:
    """``keys, sketch``: a sketch of the distinct values per group."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg(value, lg).alias("sketch"))


def merged_distinct(states: DataFrame, keys: Sequence[str], lg: int = DISTINCT_LG) -> DataFrame:
    """``keys, sketch`` of the union of the states of each group."""
    return states.groupBy(*keys).agg(F.theta_union_agg("sketch", lg).alias("sketch"))


def distinct_count(sketch: Column | str) -> Column:
    return F.theta_sketch_estimate(sketch)


def common_count(sketch: Column | str, other: Column | str) -> Column:
    """Estimated number of values that both sketches saw."""
    return F.theta_sketch_estimate(F.theta_intersection(sketch, other))
