"""SC4-SC6: random sample, first and last rows.

A DataFrame has no implicit row order, so head/tail take the ordering key
explicitly. ``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: each
task keeps its own top n, so only n rows per task reach the final merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.session import reliable


def sample_rows(df: DataFrame, n: int, seed: int = 42, fraction: float | None = None, key=None) -> DataFrame:
    """Uniform random sample of exactly ``n`` rows (or a Bernoulli ``fraction``).

    With a unique ``key`` (a column or several) the rows are ranked by its seeded
    digest (see ``drawn_by``): the same rows whatever the partitions. Without one every row draws its
    own number, so equal rows are drawn independently; the ``n`` rows are then
    checkpointed, and a lost executor cannot change the choice.
    """
    if fraction is not None:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    if key is not None:
        keys = [key] if isinstance(key, str) else list(key)
        return df.orderBy(drawn_by(keys, seed), *keys).limit(n)
    drawn = df.withColumn("_sample_key", F.rand(seed)).orderBy("_sample_key").limit(n).drop("_sample_key")
    return reliable(drawn)


def drawn_by(key, seed: int = 42) -> Column:
    """The order in which rows are drawn: MD5 of ``seed|key|...`` as text, which other engines can repeat."""
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys]).cast("binary"))


def sample_per_group(df: DataFrame, by, n: int, key, seed: int = 42) -> DataFrame:
    """DS5: exactly ``n`` random rows of every group, or all rows of a smaller one, the same for any partitions.

    The n rows with the smallest seeded digest of the ``key`` (a column or several that tell rows apart). Every task
    keeps the n smallest of each group before the shuffle (a group limit below the window), so a group of a
    third of all rows sends no more than the others. A null group is a group; rows of equal key stand in any order.
    """
    groups = [by] if isinstance(by, str) else list(by)
    keys = [key] if isinstance(key, str) else list(key)
    rest = [F.col(f"`{c}`") for c in df.columns]
    order = Window.partitionBy(*[F.col(f"`{g}`") for g in groups]).orderBy("_drawn", *[F.col(f"`{k}`") for k in keys])
    return (df.select(*rest, drawn_by(keys, seed).alias("_drawn")).withColumn("_place", F.row_number().over(order))
            .where(F.col("_place") <= n).select(*rest))


def head_rows(df: DataFrame, n: int, order_by) -> DataFrame:
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*cols).limit(n)


def tail_rows(df: DataFrame, n: int, order_by) -> DataFrame:
    """Last ``n`` rows by ``order_by``, returned in ascending order."""
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    last = df.orderBy(*[F.col(c).desc() for c in cols]).limit(n)
    return last.orderBy(*cols)


def sample_by(df: DataFrame, column: str, fractions: dict, seed: int = 42) -> DataFrame:
    """Stratified Bernoulli sample: a fraction per value of ``column`` (DS5 point clouds).

    Rows of values missing from ``fractions`` are not sampled. Each task samples
    its own rows, so nothing is gathered anywhere.
    """
    return df.sampleBy(column, fractions, seed)
