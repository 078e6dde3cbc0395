"""Grouped counts, shares, conditional rates and pivots (AG1-AG15, PR4, JN2, JN3).

All of these reduce with partial (map-side) aggregation, so a key holding a
third of the rows costs one combined row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.ratios import pct_rounded, safe_ratio


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _keys(keys) -> list:
    if keys is None:
        return []
    return [keys] if isinstance(keys, (str, Column)) else list(keys)


def count_by(df: DataFrame, keys, count_col: str = "n", non_null=None) -> DataFrame:
    """AG1/AG2: rows (or non-null ``non_null`` values) per key."""
    agg = F.count(_col(non_null)) if non_null is not None else F.count(F.lit(1))
    return df.groupBy(*_keys(keys)).agg(agg.alias(count_col))


def value_counts(df: DataFrame, column: str, count_col: str = "n") -> DataFrame:
    """AG12: counts per value, most frequent first."""
    return count_by(df, column, count_col).orderBy(F.col(count_col).desc(), F.col(column))


def share_of_total(df: DataFrame, keys, count_col: str = "n", pct_col: str = "pct",
                   rounded: int | None = None) -> DataFrame:
    """PR4/AG15: counts per key and their percent of all rows.

    The total is a scalar subquery over the (already reduced) counts, so the
    input is scanned once and no window gathers the groups in one task.
    """
    counts = count_by(df, keys, count_col)
    total = counts.agg(F.sum(count_col)).scalar()
    if rounded is None:
        pct = safe_ratio(F.col(count_col) * 100, total)
    else:
        pct = pct_rounded(F.col(count_col), total, rounded)
    return counts.withColumn(pct_col, pct)


def rate_where(df: DataFrame, keys, condition: Column, *, total_col: str = "total",
               hits_col: str = "hits", pct_col: str = "pct", scale: int | None = 2,
               count_of=None) -> DataFrame:
    """JN3 replacement: numerator and denominator in one pass.

    ``count_if(condition)`` and ``count(*)`` are computed together, so groups
    with no hits keep a 0 (decision D3) and the table is read once.
    """
    total = F.count(_col(count_of)) if count_of is not None else F.count(F.lit(1))
    hits = F.count_if(condition) if count_of is None else F.count(F.when(condition, _col(count_of)))
    out = df.groupBy(*_keys(keys)).agg(total.alias(total_col), hits.alias(hits_col))
    if pct_col:
        pct = (pct_rounded(F.col(hits_col), F.col(total_col), scale) if scale is not None
               else safe_ratio(F.col(hits_col), F.col(total_col)) * F.lit(100.0))
        out = out.withColumn(pct_col, pct)
    return out


def pivot_counts(df: DataFrame, row_keys, pivot_col: str, values: list, count_col: str) -> DataFrame:
    """AG14: long counts -> one column per listed value; absent cells are NULL.

    The value list is always given, so no discovery job runs.
    """
    return (df.groupBy(*_keys(row_keys)).pivot(pivot_col, values)
              .agg(F.sum(count_col)))
