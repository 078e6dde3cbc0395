"""Calendar helpers (DT1-DT6, FI3, FI8).

Predicates are written as half-open ranges on the raw column so that the
parquet reader receives ``GreaterThanOrEqual``/``LessThan`` pushed filters; a
``month(col) = 7`` style predicate would only push ``IsNotNull``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _as_date(v) -> _dt.date:
    if isinstance(v, _dt.datetime):
        return v.date()
    if isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v)[:10])


def _typed_bound(col_type: str, d: _dt.date) -> Column:
    """Literal of the column's type. Built from text so that neither the Python
    process's zone nor the session zone can shift a zone-less bound."""
    text = d.isoformat()
    if col_type == "date":
        return F.lit(text).cast("date")
    # parquet timestamps written without a zone load as timestamp_ntz
    return F.lit(f"{text} 00:00:00").cast(col_type)


def in_period(c, start, end, *, inclusive_end_day: bool = True, col_type: str = "timestamp_ntz") -> Column:
    """``start <= c < end + 1 day`` (or ``< end`` when ``inclusive_end_day`` is False).

    This is the intended meaning of ``c BETWEEN 'start' AND 'end'`` on a column
    that may carry a time of day (decision D5): the whole last day is kept.
    """
    lo = _as_date(start)
    hi = _as_date(end) + (_dt.timedelta(days=1) if inclusive_end_day else _dt.timedelta(0))
    x = _col(c)
    return (x >= _typed_bound(col_type, lo)) & (x < _typed_bound(col_type, hi))


def month_range(year: int, month: int, months: int = 1) -> tuple[_dt.date, _dt.date]:
    """First day of ``year-month`` and first day ``months`` later (half-open)."""
    y, m = year, month
    start = _dt.date(y, m, 1)
    m += months
    y += (m - 1) // 12
    m = (m - 1) % 12 + 1
    return start, _dt.date(y, m, 1)


def calendar_month(c) -> Column:
    return F.month(_col(c))


def calendar_year(c) -> Column:
    return F.year(_col(c))


def month_start(c) -> Column:
    """DT1: first day of the month, as a date."""
    return F.trunc(_col(c).cast("date"), "month")


def month_text(c) -> Column:
    """DT3: month start rendered as ``yyyy-MM-dd`` text."""
    return F.date_format(month_start(c), "yyyy-MM-dd")


def months_crossed(start, end) -> Column:
    """DT2: number of month boundaries crossed from ``start`` to ``end``.

    Counts calendar boundaries (Jan 31 -> Feb 1 is 1), unlike
    ``months_between`` which measures elapsed fractions of months.
    """
    s, e = _col(start), _col(end)
    return (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))


def weekday_sunday1(c) -> Column:
    """DT5: day of week with Sunday = 1 ... Saturday = 7."""
    return F.dayofweek(_col(c))


def hour_of_day(c) -> Column:
    """DT6: hour 0..23."""
    return F.hour(_col(c))


def period_filter(df, c: str, start, end, inclusive_end_day: bool = True, as_written: bool = False) -> Column:
    """``in_period`` with literals typed like the column, so the filter is pushed down.

    ``as_written=True`` reproduces ``c BETWEEN 'start' AND 'end'`` literally: on a
    column with a time of day only midnight of the end day is kept (D5).
    """
    col_type = dict(df.dtypes).get(c, "timestamp_ntz")
    if col_type not in ("date", "timestamp", "timestamp_ntz"):
        col_type = "timestamp_ntz"
    if as_written:
        x = _col(c)
        return (x >= _typed_bound(col_type, _as_date(start))) & (x <= _typed_bound(col_type, _as_date(end)))
    return in_period(c, start, end, inclusive_end_day=inclusive_end_day, col_type=col_type)
