"""Distribution operators and row positions inside groups.

Exact order statistics at scale
-------------------------------
All of them work on counts per (group, value): equal values are interchangeable, and counting them is
one map-side combined aggregation, so a value or group that holds most rows is a few rows from then on.
The counts are materialised once (``cut_lineage``, the only job that runs while a plan is built); every further step
reads them.

A value at a given rank is found by cutting each group's range into cells of a bounded number of distinct values
(:func:`tradelens.operators.keys.with_cells`), adding up the cells, and numbering the distinct values of the cells that
hold a wanted rank.  The cuts follow from the data alone, so nothing is approximate and every step sees the
same cells.  Groups may be NULL; all joins on the group are NULL-safe.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.operators.keys import CELL_ROWS, join_null_safe, with_cells
from tradelens.session import cut_lineage

RankFn = Callable[[Column, Column], Column]


def value_counts(df: DataFrame, group: Sequence[str], value: str, count: str | None = None) -> DataFrame:
    """``group, value, _c``: rows (or the sum of ``count``) per group and distinct value, materialised."""
    rows = F.count(F.lit(1)) if count is None else F.sum(count)
    return cut_lineage(df.groupBy(*group, value).agg(rows.alias("_c")))


def _group_totals(hist: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    return hist.groupBy(*group).agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), F.col("_c"))), F.lit(0)).alias("_n"),
        F.coalesce(F.sum(F.when(v.isNull(), F.col("_c"))), F.lit(0)).alias("_z"))


def order_statistics(hist: DataFrame, group: Sequence[str], value: str, targets: dict[str, RankFn],
                     cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per group: ``_n`` (non-NULL count), ``_z`` (NULL count) and, for each target, the value at 1-based
    ascending rank ``targets[name](n, z)`` among the non-NULL values (NULL when the rank is outside ``1..n``).

    ``hist`` comes from :func:`value_counts`.
    """
    g, v = list(group), F.col(value)
    values, cut = with_cells(hist.filter(v.isNotNull()), g, v, cell_rows)
    if not cut:
        return _ranks_in_one_window(hist, g, value, targets)
    totals = _group_totals(hist, g, value)
    upto = Window.partitionBy(*g).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)  # a row for each cell of a group
    cells = values.groupBy(*g, "_cell").agg(F.sum("_c").alias("_k")).withColumn("_end", F.sum("_k").over(upto))
    ranks = totals.select(*g, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_t"), targets[name](F.col("_n"), F.col("_z")).cast("long").alias("_r"))
        for i, name in enumerate(targets)])).alias("_w")).select(*g, "_w.*")
    wanted = (join_null_safe(cells, ranks, g)
              .filter((F.col("_r") <= F.col("_end")) & (F.col("_r") > F.col("_end") - F.col("_k")))
              .select(*g, "_cell", "_t", (F.col("_r") - F.col("_end") + F.col("_k")).alias("_r")))
    inside = Window.partitionBy(*g, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    held = join_null_safe(values, wanted.select(*g, "_cell").distinct(), [*g, "_cell"]).withColumn("_end", F.sum("_c").over(inside))
    found = (join_null_safe(held, wanted, [*g, "_cell"])
             .filter((F.col("_r") <= F.col("_end")) & (F.col("_r") > F.col("_end") - F.col("_c")))
             .groupBy(*g).agg(*[F.max(F.when(F.col("_t") == i, v)).alias(name) for i, name in enumerate(targets)]))
    return join_null_safe(totals.select(*g, "_n", "_z"), found, g, "left")


def _ranks_in_one_window(hist: DataFrame, g: list[str], value: str, targets: dict[str, RankFn]) -> DataFrame:
    """:func:`order_statistics` where every group is small enough for one window: one shuffle by group."""
    v, in_group = F.col(value), Window.partitionBy(*g)
    here = F.when(v.isNotNull(), F.col("_c")).otherwise(0)
    totals = {"_n": F.coalesce(F.sum(here).over(in_group), F.lit(0)), "_z": F.sum(F.col("_c") - here).over(in_group)}
    upto = in_group.orderBy(v.asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.withColumns(totals).withColumn("_end", F.sum(here).over(upto))
    picked = []
    for name, target in targets.items():
        rank = target(F.col("_n"), F.col("_z")).cast("long")
        picked.append(F.max(F.when(v.isNotNull() & (rank <= F.col("_end")) & (rank > F.col("_end") - F.col("_c")), v)).alias(name))
    return rows.groupBy(*g, "_n", "_z").agg(*picked)


def quantiles(hist: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group (position ``p * (n - 1)``, as in Spark's
    ``percentile``), plus ``_n`` and ``_z``, from :func:`value_counts`."""
    targets: dict[str, RankFn] = {}
    for name, p in probs.items():
        targets[f"{name}__a"] = lambda n, z, p=p: F.floor(F.lit(p) * (n - 1)).cast("long") + 1
        targets[f"{name}__b"] = lambda n, z, p=p: F.ceil(F.lit(p) * (n - 1)).cast("long") + 1
    st = order_statistics(hist, group, value, targets)
    cols = [F.col(c) for c in group] + [F.col("_n"), F.col("_z")]
    for name, p in probs.items():
        a, b = F.col(f"{name}__a").cast("double"), F.col(f"{name}__b").cast("double")
        pos = F.lit(p) * (F.col("_n") - 1)
        frac = pos - F.floor(pos)
        cols.append((a + frac * (b - a)).alias(name))
    return st.select(*cols)


def group_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float],
                    count: str | None = None) -> DataFrame:
    """:func:`quantiles` of the rows of ``df`` (``count``: each row stands for so many)."""
    return quantiles(value_counts(df, group, value, count), group, value, probs)


def box_stats(df: DataFrame, group: Sequence[str], value: str, whisker: float = 1.5,
              count: str | None = None) -> DataFrame:
    """Box-plot numbers per group (O9): n, q1, median, q3 and the whisker ends, i.e. the
    most extreme values within ``whisker * IQR`` of the quartiles.  ``count``: each row of ``df``
    stands for so many."""
    g = list(group)
    hist = value_counts(df, g, value, count)
    q = quantiles(hist, g, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    q = q.select(*g, F.col("_n").alias("n"), "q1", "median", "q3",
                 (F.col("q1") - F.lit(whisker) * iqr).alias("_wlo"), (F.col("q3") + F.lit(whisker) * iqr).alias("_whi"))
    v = F.col(value).cast("double")
    # one row per group meets one row per (group, distinct value)
    boxed = join_null_safe(q, hist.select(*g, value), g)
    return boxed.groupBy(*g, "n", "q1", "median", "q3").agg(
        F.min(F.when(v >= F.col("_wlo"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("_whi"), v)).alias("whisker_high"))


def group_median(df: DataFrame, group: Sequence[str], value: str, nulls: str = "lowest", out: str = "median",
                 count: str | None = None) -> DataFrame:
    """Median per group.

    ``nulls='skip'``: median of the non-NULL values.
    ``nulls='lowest'``: rows are numbered with NULLs first and the one or two middle
    rows are averaged, skipping NULLs (NULL if both middle rows are NULL).
    """
    if nulls == "skip":
        return group_quantiles(df, group, value, {out: 0.5}, count).select(*group, out)
    if nulls != "lowest":
        raise ValueError(nulls)
    st = order_statistics(value_counts(df, group, value, count), group, value, {
        "_m1": lambda n, z: F.call_function("div", n + z + 1, F.lit(2)) - z,
        "_m2": lambda n, z: F.call_function("div", n + z, F.lit(2)) + 1 - z,
    })
    a, b = F.col("_m1").cast("double"), F.col("_m2").cast("double")
    med = F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2)
    return st.select(*group, med.alias(out))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram over ``[min, max]`` of all finite values (O9b); NULL, NaN and infinities are in no bin.

    Bins are 1-based; the last bin is closed; every bin is reported (count 0
    when empty); all values fall into bin 1 when ``min == max``.  The range is
    one scalar subquery (a single global min/max job).
    """
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    rng = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("r")).scalar()
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    idx = F.when(hi == lo, F.lit(1).cast("long")).otherwise(
        F.least(F.floor(F.try_divide((v - lo) * F.lit(float(bins)), hi - lo)).cast("long") + 1,
                F.lit(bins).cast("long")))
    counts = (df.filter(v.isNotNull()).select(value, rng.alias("_r"))
              .groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"), rng.alias("_r"))
    width = F.try_divide(hi - lo, F.lit(float(bins)))
    return grid.join(counts, "bin", "left").select(
        "bin", (lo + (F.col("bin") - 1) * width).alias("bin_low"), (lo + F.col("bin") * width).alias("bin_high"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def expand_positions(hist: DataFrame, group: Sequence[str], order: str, count: str, chunk: int = 1 << 20,
                     out: str = "position", total: str = "group_count") -> DataFrame:
    """Rows numbered 1..n inside each group, ordered by ``order`` (NULLs first), from a
    histogram ``(group, order, count)`` of interchangeable rows.

    Each value's first position is a prefix sum over the histogram (:func:`prefix_counts`: no window spans a
    whole group).  Each histogram row then becomes ``count`` output rows; large counts are split into chunks of
    at most ``chunk`` positions, hash-partitioned before they are expanded, so a value held by a third of all
    rows is generated by many tasks.
    """
    from tradelens.operators.ranking import prefix_counts

    g = list(group)
    h = prefix_counts(cut_lineage(hist.select(*g, order, count)), g, order, count)
    nchunks = F.call_function("div", F.col(count) + (chunk - 1), F.lit(chunk))
    chunks = (h.select(*g, order, count, "_start", F.col("_n").alias(total),
                       F.explode(F.sequence(F.lit(0), nchunks - 1)).alias("_ch"))
              .repartition(*g, order, "_ch"))
    first = F.col("_start") + F.col("_ch") * chunk + 1
    last = F.least(F.col("_start") + (F.col("_ch") + 1) * chunk, F.col("_start") + F.col(count))
    return chunks.select(*g, order, F.explode(F.sequence(first, last)).alias(out), total)
