"""Trend operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.functions.numeric import safe_div
from tradelens.operators.keys import join_null_safe


def co_moments(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Centred co-moments of the complete ``(x, y)`` pairs per group: count, means, and the sums of squares and
    products of the deviations from the means (``m2_x``, ``m2_y``, ``c_xy``).

    Rows with a NULL ``x`` or ``y`` take no part.  The sums are Spark's own central moments, which tasks build around
    their running means and merge in pairs, so large offsets cancel no digits.  The rows are a state that can be
    stored and merged later (:func:`merge_co_moments`) without the data.
    """
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_count(yc, xc).alias("n"), F.regr_avgx(yc, xc).alias("mean_x"), F.regr_avgy(yc, xc).alias("mean_y"),
        F.regr_sxx(yc, xc).alias("m2_x"), F.regr_syy(yc, xc).alias("m2_y"), F.regr_sxy(yc, xc).alias("c_xy"))


def merge_co_moments(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The co-moments of all rows behind several states (:func:`co_moments`) per group.

    Two states of n and m rows merge into ``c = c1 + c2 + n m / (n + m) (mean_x1 - mean_x2) (mean_y1 - mean_y2)``.  For
    any number of them, the second part is the co-moment of the states' means around their common mean, with the
    counts as weights, so they are merged by two aggregations whatever their number.
    """
    used = states.filter(F.col("n") > 0)
    means = used.groupBy(*keys).agg(F.sum("n").alias("_n"), *[
        (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"_{c}") for c in ("mean_x", "mean_y")])
    joined = join_null_safe(used, means, keys) if keys else used.join(means)  # without keys: one row of means
    dx, dy, n = F.col("mean_x") - F.col("_mean_x"), F.col("mean_y") - F.col("_mean_y"), F.col("n")
    return joined.groupBy(*keys, "_n", "_mean_x", "_mean_y").agg(
        F.sum(F.col("m2_x") + n * dx * dx).alias("m2_x"), F.sum(F.col("m2_y") + n * dy * dy).alias("m2_y"),
        F.sum(F.col("c_xy") + n * dx * dy).alias("c_xy")).select(
        *keys, F.col("_n").alias("n"), F.col("_mean_x").alias("mean_x"), F.col("_mean_y").alias("mean_y"), "m2_x", "m2_y", "c_xy")


def line_of_moments(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, slope, intercept`` of co-moments; NULL where all ``x`` are equal."""
    slope = F.when(F.col("m2_x") > 0, F.col("c_xy") / F.col("m2_x"))
    return states.select(*keys, slope.alias("slope"), (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"))


def _scale(kind: T.DataType) -> int | None:
    """Decimal places of an exact type that products keep; None for all other types."""
    if isinstance(kind, T.IntegralType):
        return 0
    return kind.scale if isinstance(kind, T.DecimalType) and 0 <= kind.scale <= 9 else None


def _sum_all(term: Column) -> Column:
    """Aggregate: the exact sum; NULL if it, or one of its terms among the ``_pair`` rows, passes 38 digits."""
    return F.when(F.count(term) == F.count_if("_pair"), F.try_sum(term))


def fit_line(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Ordinary least squares ``y = intercept + slope * x`` per group over the complete pairs.

    Rows with a NULL ``x`` or ``y`` take no part.  Slope and intercept are NULL when all ``x`` are equal
    (including a single point) or no pair is complete.

    Whole numbers and decimals (days, cents) are fitted from exact sums in whole units of their last place, with one
    division at the end, so the result does not depend on the order of the work.  Where a number passes 38
    digits on the way, and for all other types, the line comes from centred co-moments (:func:`co_moments`).
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    places = [_scale(kinds[x]), _scale(kinds[y])]
    if None in places:
        return line_of_moments(co_moments(df, keys, x, y), keys)
    whole = "decimal(38,0)"

    def unit(scale: int) -> Column:
        return F.lit(10 ** scale).cast("decimal(10,0)")

    pairs = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn(
        "_pair", F.col("_x").isNotNull() & F.col("_y").isNotNull())
    for c, out, scale in (("_x", "_u", places[0]), ("_y", "_v", places[1])):
        wide = F.col(c).cast(f"decimal(38,{scale})") if scale else F.col(c).cast(whole)
        pairs = pairs.withColumn(out, F.when(F.col("_pair"), F.try_multiply(wide, unit(scale)).cast(whole)))
    u, v, xc, yc = F.col("_u"), F.col("_v"), F.col("_x").cast("double"), F.col("_y").cast("double")
    sums = pairs.groupBy(*keys).agg(
        F.count_if("_pair").cast(whole).alias("_n"), _sum_all(u).alias("_su"), _sum_all(v).alias("_sv"),
        _sum_all(F.try_multiply(u, u)).alias("_suu"), _sum_all(F.try_multiply(u, v)).alias("_suv"),
        F.regr_sxx(yc, xc).alias("m2_x"), F.regr_sxy(yc, xc).alias("c_xy"),
        F.regr_avgx(yc, xc).alias("mean_x"), F.regr_avgy(yc, xc).alias("mean_y"))

    def minus(a: tuple[str, str], b: tuple[str, str]) -> Column:
        return F.try_subtract(F.try_multiply(*map(F.col, a)), F.try_multiply(*map(F.col, b)))

    spread = minus(("_n", "_suu"), ("_su", "_su"))
    sums = sums.withColumns({
        "_den": F.try_multiply(spread, unit(places[1])),
        "_rise": F.try_multiply(minus(("_n", "_suv"), ("_su", "_sv")), unit(places[0])),
        "_level": minus(("_sv", "_suu"), ("_su", "_suv"))})
    rough = line_of_moments(sums.select(*keys, "m2_x", "c_xy", "mean_x", "mean_y", "_den", "_rise", "_level"),
                            [*keys, "_den", "_rise", "_level"])
    return rough.select(*keys, *[F.when(F.col("_den").isNotNull() & F.col(num).isNotNull(), safe_div(num, "_den"))
                                 .otherwise(F.col(out)).alias(out) for out, num in (("slope", "_rise"), ("intercept", "_level"))])


def rank_slopes(model: DataFrame, out: str = "growth_rank") -> DataFrame:
    """Rank groups by slope, steepest growth first ("fastest growing").

    ``model`` has one row per group (a category list), so the global window is small.
    """
    return model.withColumn(out, F.rank().over(Window.orderBy(F.col("slope").desc_nulls_last())).cast("long"))


def score_line(model: DataFrame, keys: Sequence[str], lo: int, hi: int, x: str = "day",
               out: str = "fitted") -> DataFrame:
    """Fitted value for every integer ``x`` in ``[lo, hi]`` per model row.

    The range is generated per model row (no cross join).
    """
    return model.select(*keys, "slope", "intercept", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias(x)).select(
        *keys, F.col(x).cast("long").alias(x), (F.col("intercept") + F.col("slope") * F.col(x)).alias(out))


def centered_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, before: int = 2, after: int = 2,
                  out: str = "moving_avg") -> DataFrame:
    """Mean of the rows from ``before`` rows back to ``after`` rows ahead.

    The frame counts rows, not calendar days: a missing day is simply skipped.
    NULL values are left out of the mean.  The sum is taken left to right with
    ``lag``/``lead`` so the result is reproducible to the last bit.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    neighbours: list[Column] = [F.lag(value, i).over(w) for i in range(before, 0, -1)]
    neighbours += [F.col(value)] + [F.lead(value, i).over(w) for i in range(1, after + 1)]
    total, count = None, None
    for c in neighbours:
        term, one = F.coalesce(c.cast("double"), F.lit(0.0)), F.when(c.isNotNull(), 1).otherwise(0)
        total = term if total is None else total + term
        count = one if count is None else count + one
    return df.withColumn(out, F.when(count > 0, total / count))


def seasonal_forecast(daily: DataFrame, model: DataFrame, keys: Sequence[str], day: str, value: str,
                      shift_days: int, target_lo: int, target_hi: int) -> DataFrame:
    """Forecast ``value * fit(day + shift) / fit(day)`` for target days.

    Only base days whose shifted day lies in ``[target_lo, target_hi]`` are kept;
    the bound is on ``day`` itself, so it filters before the join.
    """
    base = daily.filter(F.col(day).between(target_lo - shift_days, target_hi - shift_days))
    joined = base.join(model, list(keys))
    fit_now = F.col("intercept") + F.col("slope") * F.col(day)
    fit_then = F.col("intercept") + F.col("slope") * (F.col(day) + F.lit(shift_days))
    return joined.withColumn("forecast", F.try_divide(fit_then, fit_now) * F.col(value).cast("double"))
