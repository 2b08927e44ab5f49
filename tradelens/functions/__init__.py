from tradelens.functions.numeric import as_double, mean_of, mean_of_units, ratio_units, round_ratio, safe_div
from tradelens.functions.timecols import (
    MICROS_PER_DAY,
    WEEKDAY_LABELS,
    between_half_open,
    day_index,
    elapsed_days,
    elapsed_micros,
    iso_day,
    mean_days,
    shift_year,
    ts_literal,
    weekday_label,
    weekday_number,
    year_month,
)

__all__ = [
    "MICROS_PER_DAY", "WEEKDAY_LABELS", "as_double", "between_half_open", "day_index", "elapsed_days",
    "elapsed_micros", "iso_day", "mean_days", "mean_of", "mean_of_units", "ratio_units", "round_ratio",
    "safe_div", "shift_year",
    "ts_literal", "weekday_label", "weekday_number", "year_month",
]
