"""Exact ratios and rounding (MA1, MA2, D13, D14, D20).

Counts are divided as decimals, never as doubles, and rounded HALF_UP only at
the end, so ``12.345`` rounds to ``12.35`` exactly as a decimal engine would.
Division by zero yields NULL (``try_divide``), never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _exact(c) -> Column:
    # bigint counts fit decimal(20,0); dividing two of them keeps 18 fraction digits
    return _col(c).cast("decimal(20,0)")


def ratio_rounded(num, den, scale: int = 2, as_double: bool = True) -> Column:
    """``round(num / den, scale)`` computed in decimal, HALF_UP."""
    r = F.round(F.try_divide(_exact(num), _exact(den)), scale)
    return r.cast("double") if as_double else r


def pct_rounded(num, den, scale: int = 2, as_double: bool = True) -> Column:
    """``round(num / den * 100, scale)`` computed in decimal, HALF_UP."""
    r = F.round(F.try_divide(_exact(num), _exact(den)) * F.lit(100), scale)
    return r.cast("double") if as_double else r


def safe_ratio(num, den) -> Column:
    """Unrounded ratio as one IEEE division; NULL when ``den`` is 0 or NULL."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def round_decimal(c, scale: int, work_type: str = "decimal(38,10)") -> Column:
    """Round a double through a decimal so that 1.005 -> 1.01 (D13)."""
    return F.round(_col(c).cast(work_type), scale).cast("double")


def number(c) -> Column:
    """A double in which NaN is NULL: both mean a missing value."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)
