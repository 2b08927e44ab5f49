"""Aggregation operators.

Conventions: every operator takes DataFrames plus column names and returns a
lazy DataFrame.  Global totals are attached with scalar subqueries
(``DataFrame.scalar()``): Spark runs them once as a separate small job and
inlines the value, so no row is moved to a single partition and no cross join
appears in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numeric import mean_of_units, ratio_units, round_ratio, safe_div


def two_level_stats(df: DataFrame, key: str, measure: Column | str, digits: int = 2) -> DataFrame:
    """Sum ``measure`` per ``key``, then min / mean (rounded, exact) / max over the keys (O1)."""
    m = F.col(measure) if isinstance(measure, str) else measure
    per_key = df.groupBy(key).agg(F.sum(m).alias("_total"))
    return per_key.agg(
        F.min("_total").cast("double").alias("min_value"),
        round_ratio(F.sum("_total"), F.count("_total"), digits).alias("avg_value"),
        F.max("_total").cast("double").alias("max_value"))


def top_n(df: DataFrame, measure: str, n: int, tie_break: Sequence[str], ascending: bool = False) -> DataFrame:
    """The ``n`` largest (or smallest) rows by ``measure``; ties broken by ``tie_break``.

    Planned as TakeOrderedAndProject: each task keeps its own top ``n``.
    """
    order = F.asc(measure) if ascending else F.desc(measure)
    return df.orderBy(order, *[F.asc(c) for c in tie_break]).limit(n)


def pivot_measure(df: DataFrame, row_keys: Sequence[str], pivot_col: str, values: Sequence,
                  names: Sequence[str], how: str = "count", measure: str | None = None) -> DataFrame:
    """Fixed-value pivot (O2).

    ``how='count'`` counts rows per cell and fills empty cells with 0;
    ``how='sum'`` sums ``measure`` and leaves empty cells NULL.  Explicit values
    avoid the extra job Spark would run to discover them.
    """
    grouped = df.groupBy(*row_keys).pivot(pivot_col, list(values))
    if how == "count":
        wide = grouped.agg(F.count(F.lit(1)))
    elif how == "sum":
        wide = grouped.agg(F.sum(measure))
    else:
        raise ValueError(how)
    cols = [F.col(k) for k in row_keys]
    for v, name in zip(values, names):
        c = F.col(f"`{v}`")
        cols.append((F.coalesce(c, F.lit(0)) if how == "count" else c).alias(name))
    return wide.select(*cols)


def top_n_with_other(ranked: DataFrame, key: str, measure: str, rank_col: str, n: int,
                     other_label: str) -> DataFrame:
    """Rows ranked ``<= n`` plus one remainder row summing the rest (O3).

    Ties at rank ``n`` are all kept.  The remainder row is always present; its
    measure is NULL when nothing is left over.  One pass: every row is relabelled
    (its own key or the remainder label) and summed per label; a single NULL row
    for the remainder label guarantees the row exists.
    """
    label = F.when(F.col(rank_col) <= n, F.col(key)).otherwise(F.lit(other_label)).alias(key)
    rows = ranked.select(label, F.col(measure))
    placeholder = ranked.sparkSession.range(1).select(
        F.lit(other_label).alias(key), F.lit(None).cast(ranked.schema[measure].dataType).alias(measure))
    return rows.unionByName(placeholder).groupBy(key).agg(F.sum(measure).alias(measure))


def share_of_total(df: DataFrame, measure: str, out: str = "share") -> DataFrame:
    """Each row's share of the global sum of ``measure``."""
    return df.withColumn(out, safe_div(F.col(measure), df.agg(F.sum(measure)).scalar()))


def cell_vs_mean(cells: DataFrame, value: str, out: str = "above_mean") -> DataFrame:
    """Flag each matrix cell above the grand mean of all cells (O10, long form)."""
    mean = cells.agg(safe_div(F.sum(value), F.count(value))).scalar()
    return cells.withColumn("grand_mean", mean).withColumn(out, F.col(value) > F.col("grand_mean"))


def mean_of_means(df: DataFrame, total: str, count: str, scale: int, out: str = "mean_value",
                  units: int = 10 ** 12) -> DataFrame:
    """Unweighted mean of per-group means (O10), one row: each group's mean is ``total / count / scale``.

    Group means are rounded to whole numbers of ``1 / units``, so their sum does not depend on the order of
    the rows; the result is within ``0.5 / units`` of the exact mean (tested).
    """
    means = ratio_units(F.col(total), F.col(count) * F.lit(scale), units)
    return df.agg(mean_of_units(means, units).alias(out))


def bubble_scale(df: DataFrame, count_col: str, value_col: str, radius_factor: float = 0.1,
                 base_opacity: float = 0.1, opacity_factor: float = 0.1) -> DataFrame:
    """Marker sizes for a bubble map.

    ``radius = radius_factor * sqrt(count)``,
    ``opacity = base + factor * sqrt(value / max(value))``.
    """
    vmax = df.agg(F.max(value_col)).scalar()
    return df.select(
        "*",
        (F.lit(radius_factor) * F.sqrt(F.col(count_col).cast("double"))).alias("radius"),
        (F.lit(base_opacity) + F.lit(opacity_factor) * F.sqrt(safe_div(F.col(value_col), vmax))).alias("opacity"))
