"""Time columns (calendar arithmetic without time zones).

All timestamps are ``timestamp_ntz``: purchase times are wall-clock values and
no conversion is wanted.  Every helper returns a ``Column``; nothing here
triggers a job.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# English weekday abbreviations, Sunday first (weekday 0 = Sunday).
WEEKDAY_LABELS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_literal(value) -> Column:
    """A ``timestamp_ntz`` literal from 'YYYY-MM-DD[ HH:MM:SS]', a date or a datetime."""
    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(value, _dt.date):
        text = value.isoformat()
    else:
        text = str(value)
    return F.to_timestamp_ntz(F.lit(text))


def _micros_of_day(ts: Column) -> Column:
    seconds = F.date_part(F.lit("SECOND"), ts)          # decimal(8,6): seconds with microseconds
    return (F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000
            + (seconds * 1_000_000).cast("long"))


def elapsed_micros(start, end) -> Column:
    """Exact signed microseconds from ``start`` to ``end`` (NULL if either is NULL).

    Wall-clock arithmetic on the calendar fields (whole days plus time of day), so
    the result never depends on the session time zone; Spark's ``timestampdiff``
    on ``timestamp_ntz`` shifts across daylight-saving changes of that zone.
    """
    a, b = _c(start), _c(end)
    days = F.datediff(F.to_date(b), F.to_date(a)).cast("long")
    return days * MICROS_PER_DAY + (_micros_of_day(b) - _micros_of_day(a))


def elapsed_days(start, end) -> Column:
    """Fractional days from ``start`` to ``end`` (a Julian-day difference)."""
    return F.try_divide(elapsed_micros(start, end).cast("double"), F.lit(float(MICROS_PER_DAY)))


def mean_days(micros) -> Column:
    """Aggregate: mean of a microsecond column, in fractional days.

    Summed as an exact integer and divided once, so the result does not depend
    on how partial sums were combined across tasks.
    """
    m = _c(micros)
    return F.try_divide(F.try_divide(F.sum(m).cast("double"), F.count(m).cast("double")),
                        F.lit(float(MICROS_PER_DAY)))


def day_index(ts, origin) -> Column:
    """Whole days since ``origin`` (a date string); equals truncation of the Julian difference for ts >= origin."""
    return F.datediff(F.to_date(_c(ts)), F.to_date(F.lit(str(origin))))


def iso_day(ts) -> Column:
    """Calendar day as ISO text 'YYYY-MM-DD'."""
    return F.date_format(F.to_date(_c(ts)), "yyyy-MM-dd")


def year_month(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def shift_year(d, years: int = 1) -> Column:
    """Same calendar day ``years`` later; 29 Feb becomes 28 Feb."""
    return F.add_months(_c(d), 12 * years)


def between_half_open(ts, lo=None, hi=None) -> Column:
    """``lo <= ts < hi``; either bound may be omitted.

    Comparing a timestamp with a bare date bound keeps the predicate a plain
    comparison against a literal, so Parquet can push it down.
    """
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (_c(ts) >= ts_literal(lo))
    if hi is not None:
        cond = cond & (_c(ts) < ts_literal(hi))
    return cond


def weekday_number(ts) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(_c(ts)) - 1


def weekday_label(ts) -> Column:
    labels = F.array(*[F.lit(x) for x in WEEKDAY_LABELS])
    return F.element_at(labels, F.dayofweek(_c(ts)))
