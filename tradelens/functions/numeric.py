"""Numeric helpers that keep results exact and independent of task order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(x) -> Column:
    return _c(x).cast("double")


def safe_div(num, den) -> Column:
    """``num / den`` in double precision; NULL when ``den`` is 0 or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def mean_of(x) -> Column:
    """Aggregate: exact sum divided once by the non-NULL count (order independent)."""
    return safe_div(F.sum(_c(x)), F.count(_c(x)))


def round_ratio(num, den, digits: int) -> Column:
    """``num / den`` rounded half away from zero to ``digits`` decimals, exactly.

    ``num`` must be an integer or decimal column with at most ``digits`` scale
    after scaling, ``den`` a positive integer.  Works on integers, so there is
    no double rounding.
    """
    scale = 10 ** digits
    units = (_c(num) * F.lit(scale)).cast("decimal(38,0)")
    den = _c(den).cast("decimal(38,0)")
    mag = F.call_function("div", F.abs(units) * 2 + den, den * 2)
    return F.when(den > 0, F.signum(units) * mag.cast("double") / F.lit(float(scale)))


def ratio_units(num, den, scale: int) -> Column:
    """``num / den * scale`` rounded half away from zero, as an exact integer (decimal(38,0)).

    ``num`` is an integer or decimal column whose product with ``scale`` is whole,
    ``den`` a positive integer.  Summing such units is exact and order independent,
    which a sum of doubles is not.
    """
    n = (_c(num).cast("decimal(38,6)") * F.lit(scale).cast("decimal(20,0)")).cast("decimal(38,0)")
    d = _c(den).cast("decimal(38,0)")
    mag = F.call_function("div", F.abs(n) * 2 + d, d * 2).cast("decimal(38,0)")
    return F.when(d > 0, F.when(n < 0, -mag).otherwise(mag))


def mean_of_units(units, scale: int) -> Column:
    """Aggregate: mean of fixed-point ``units`` (value * ``scale``) as a double; exact sum, one division."""
    u = _c(units)
    return F.try_divide(F.try_divide(F.sum(u).cast("double"), F.count(u).cast("double")), F.lit(float(scale)))
