"""Column expressions, JVM-side inside whole-stage codegen."""

from bizlens.functions.periods import (
    in_period, month_start, month_text, months_crossed, weekday_sunday1,
    hour_of_day, calendar_month, calendar_year, month_range, period_filter,
)
from bizlens.functions.bands import band, band_labels, band_ordinal
from bizlens.functions.ratios import pct_rounded, ratio_rounded, safe_ratio, round_decimal
from bizlens.functions.text import strip_pattern, normalise_spelling, contains_text, parse_number

__all__ = [
    "in_period", "month_start", "month_text", "months_crossed", "weekday_sunday1",
    "hour_of_day", "calendar_month", "calendar_year", "month_range", "period_filter",
    "band", "band_labels", "band_ordinal",
    "pct_rounded", "ratio_rounded", "safe_ratio", "round_decimal",
    "strip_pattern", "normalise_spelling", "contains_text", "parse_number",
]
