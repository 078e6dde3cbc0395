"""Order over a whole table without gathering it in one task: row index, running total, ranks, side by side
(AG13, DS8, WN2, FI11, PJ6, JN7).

A window without a partition puts all rows in one task. Here rows are range-partitioned in their order and written,
each range is summed, and what stands before a range is added to what a range finds in itself. One number a
range reaches the driver, as many as the shuffle has partitions. The written frame fixes ranges and order, so
a lost executor changes nothing.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.session import reliable


def _orders(order_by) -> list[Column]:
    cols = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in cols]


def _before(spark, totals: dict, kind: str, zero) -> DataFrame:
    """Range -> total of the ranges before it."""
    parts = sorted(totals)
    sums = list(accumulate([totals[p] for p in parts], initial=zero))
    return spark.createDataFrame(list(zip(parts, sums)), f"_part int, _before {kind}")


def row_index(df: DataFrame, order_by=None, name: str = "index") -> DataFrame:
    """Add a gapless row number from 0: in the order of ``order_by`` (names or ordering Columns), or as the
    rows are read.

    Ties stand in any order, which is then fixed: rows are dealt by a running number too, so one value of a
    third of all rows spreads over several ranges. Without ``order_by`` rows stay in their partitions,
    nothing is shuffled. An existing column ``name`` is replaced; an empty frame stays empty.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    if order_by is not None:
        order = [*_orders(order_by), F.col("_row")]
        df = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    df = reliable(df.select(*rest))
    counts = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = _before(df.sparkSession, counts, "long", 0)
    placed = df.select(*rest, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    # the low 33 bits are the position in the partition
    index = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "_part").select(*rest, index.alias(name))


def running_total(df: DataFrame, order_by, value_col: str, out_col: str = "cumulative") -> DataFrame:
    """Add the sum of ``value_col`` over all rows up to each row in the order of ``order_by``; its type is that
    of ``sum``.

    Null values add nothing (the total is null before the first value). Rows that are equal in the order stand in any
    order, which is then fixed. An existing column ``out_col`` is replaced. Two shuffles: by range, and for the
    sums inside ranges by range number.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != out_col]
    order = [*_orders(order_by), F.col("_row")]
    value = F.col(f"`{value_col}`")
    df = (df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order)
          .select(*rest, "_row", value.alias("_value"), F.spark_partition_id().alias("_part")))
    df = reliable(df)
    sums = df.groupBy("_part").agg(F.sum("_value").alias("s"))
    kind = sums.schema["s"].dataType.simpleString()
    totals = {r["_part"]: r["s"] for r in sums.collect()}
    seen, before = None, []
    for p in sorted(totals):
        before.append((p, seen))
        if totals[p] is not None:
            seen = totals[p] if seen is None else seen + totals[p]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, f"_part int, _before {kind}"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = df.withColumn("_sum", F.sum("_value").over(inside)).join(offsets, "_part")
    total = F.coalesce((F.col("_before") + F.col("_sum")).cast(kind), F.col("_sum"), F.col("_before"))
    return part.select(*rest, total.alias(out_col))


def global_rank(df: DataFrame, value: str, descending: bool = True, name: str = "rank", dense: bool = True) -> DataFrame:
    """WN2/WN3: rank of every row by ``value`` over the whole frame, from 1, equal values alike; null values
    come last. ``dense=False`` leaves gaps after ties.

    Distinct values are ranked, counted before the shuffle, and joined back to the rows.
    """
    v = F.col(f"`{value}`")
    order = F.col("_v").desc_nulls_last() if descending else F.col("_v").asc_nulls_last()
    levels = df.groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    if dense:
        ranked = row_index(levels, order, "_rank").select("_v", (F.col("_rank") + 1).alias("_rank"))
    else:
        ranked = running_total(levels, order, "_n", "_end").select("_v", (F.col("_end") - F.col("_n") + 1).alias("_rank"))
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.join(ranked, v.eqNullSafe(F.col("_v"))).select(*rest, F.col("_rank").cast("int").alias(name))


def top_global(df: DataFrame, value: str, ranks, descending: bool = True) -> DataFrame:
    """FI11: rows whose dense rank is among ``ranks``."""
    ranked = global_rank(df, value, descending, "_place")
    return ranked.where(F.col("_place").isin([int(r) for r in ranks])).drop("_place")


def side_by_side(left: DataFrame, right: DataFrame, left_order=None, right_order=None) -> DataFrame:
    """PJ6: the columns of two frames next to each other, row by row, without a key; the shorter frame is filled
    with nulls. A column name of ``right`` that ``left`` has too is given ``_right``.

    Rows stand in the given orders, or as they are read. Both frames get a row index and are joined on it.
    """
    taken = set(left.columns)
    names = {c: c if c not in taken else f"{c}_right" for c in right.columns}
    a, b = row_index(left, left_order, "_index"), row_index(right, right_order, "_index")
    b = b.select("_index", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return a.join(b, "_index", "full").select(*[F.col(f"`{c}`") for c in (*left.columns, *names.values())])
