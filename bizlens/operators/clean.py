"""Cleaning (CL1-CL4, NU1-NU3, CO6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.text import normalise_spelling, parse_number, strip_pattern

# The currency prefix and the spelling fixes of the claims data.
CURRENCY_PREFIX = "R$ "
CAUSE_FIXES = [("vegetables", "vegetable"), (" meat", "meat")]


def strip_currency(df: DataFrame, column: str, prefix: str = CURRENCY_PREFIX,
                   to_type: str = "decimal(18,2)", lenient: bool = False) -> DataFrame:
    """CL1: drop the currency prefix and parse; bad text raises unless ``lenient``."""
    return df.withColumn(column, parse_number(strip_pattern(column, prefix), to_type, lenient))


def normalise_category(df: DataFrame, column: str, fixes=CAUSE_FIXES, lower: bool = True) -> DataFrame:
    """CL2: lower-case then apply substring fixes in order."""
    return df.withColumn(column, normalise_spelling(column, list(fixes), lower))


def fill_mean(df: DataFrame, column: str, exact_scale: int | None = None) -> DataFrame:
    """NU1/CL3: replace NULLs by the column mean.

    The mean is a scalar subquery (one partial aggregation). With
    ``exact_scale`` the values are summed as decimals of that scale, so the
    mean does not depend on the order in which tasks add them.
    """
    c = F.col(column)
    if exact_scale is not None:
        s = F.sum(c.cast(f"decimal(38,{exact_scale})")).cast("double")
        mean = df.agg(F.try_divide(s, F.count(c).cast("double")).alias("_m")).scalar()
    else:
        mean = df.agg(F.avg(c)).scalar()
    return df.withColumn(column, F.coalesce(c, mean.cast(df.schema[column].dataType)))


def fill_value(df: DataFrame, column: str, value) -> DataFrame:
    """NU2: replace NULLs by a constant."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def map_values(column, mapping: dict) -> Column:
    """CO6: value mapping; unmapped values become NULL. Pure function of the input (D24)."""
    c = F.col(column) if isinstance(column, str) else column
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def cut_above(df: DataFrame, column: str, threshold, inclusive: bool = False) -> DataFrame:
    """CL4: keep rows below a fixed threshold (NULLs are dropped, as in the source)."""
    c = F.col(column)
    return df.where(c <= threshold if inclusive else c < threshold)
