"""Distributions behind the charts (DS1-DS8)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.ratios import number, round_decimal
from bizlens.operators.quantiles import BROADCAST_GROUPS, approx_quantiles, exact_quantiles
from bizlens.operators.scan import running_total
from bizlens.session import reliable


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """DS1: equal-width bins between min and max; the max belongs to the last bin.

    Bin edges come from one scalar aggregation. Every bin is reported, empty
    ones with 0, by joining the counts to the (parameter-sized) bin axis. NaN is
    missing, like NULL.
    """
    x = number("`" + column + "`")
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    idx = F.when(hi > lo, F.least(F.floor((x - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (axis.join(counts, "bin", "left")
                .select("bin",
                        (lo + F.col("bin") * width).alias("bin_lo"),
                        F.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                        F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def binned_counts(df: DataFrame, keys) -> DataFrame:
    """DS2/DS4/DS7: counts per (already binned or categorical) keys."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, value: str, by, whisker: float = 1.5,
              digits: int | None = 6, method: str = "exact") -> DataFrame:
    """DS3: quartiles, whiskers clamped to the data, and outlier count per group.

    Quartiles are exact and distributed (rounded to ``digits`` through a
    decimal, which is exact for money-like inputs); one more pass over the
    data counts outliers and finds the whisker ends against the fences. The
    keys and values are written once for the three passes.
    """
    keys = [by] if isinstance(by, str) else list(by)
    df = reliable(df.select(*keys, number(value).alias("_x")).where(F.col("_x").isNotNull()))
    value = "_x"
    if method == "approx":  # one percentile_approx pass instead of the exact multi-pass operator
        q = approx_quantiles(df, value, [0.25, 0.5, 0.75], by=keys, names=["q1", "median", "q3"])
    else:
        q = exact_quantiles(df, value, [0.25, 0.5, 0.75], by=keys, names=["q1", "median", "q3"])
    if digits is not None:
        for c in ("q1", "median", "q3"):
            q = q.withColumn(c, round_decimal(c, digits))
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
          .withColumn("_lf", F.col("q1") - F.lit(whisker) * F.col("iqr"))
          .withColumn("_hf", F.col("q3") + F.lit(whisker) * F.col("iqr")))
    q = reliable(q)  # a row per group
    fences = q.select(*keys, "_lf", "_hf")
    if fences.count() <= BROADCAST_GROUPS:  # the rows stay where they are
        fences = F.broadcast(fences)
    j = df.join(fences, keys)
    ends = j.groupBy(*keys).agg(
        F.min(F.when(F.col("_x") >= F.col("_lf"), F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(F.col("_x") <= F.col("_hf"), F.col("_x"))).alias("whisker_hi"),
        F.count_if((F.col("_x") < F.col("_lf")) | (F.col("_x") > F.col("_hf"))).alias("n_outliers"))
    return q.drop("_lf", "_hf").join(ends, keys)


def binned_2d(df: DataFrame, x: str, y: str, x_width: float, y_width: float, by=None) -> DataFrame:
    """DS5: 2-D histogram (optionally per category) instead of a point cloud."""
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    return (df.groupBy(*keys,
                       F.floor(F.col(x) / F.lit(x_width)).alias("x_bin"),
                       F.floor(F.col(y) / F.lit(y_width)).alias("y_bin"))
              .agg(F.count(F.lit(1)).alias("n")))


def smoothed_density(binned: DataFrame, bandwidth_bins: float = 1.0, radius: int | None = None,
                     by=None) -> DataFrame:
    """DS6: Gaussian-kernel density over a 2-D bin grid (kde on binned data).

    Each occupied bin spreads its count to neighbours within ``radius`` bins
    (a fixed stencil, so rows grow by a constant factor); densities are
    normalised to sum to 1 per group.
    """
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    r = radius if radius is not None else max(1, int(math.ceil(3 * bandwidth_bins)))
    offsets = [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2.0 * bandwidth_bins ** 2)))
               for dx in range(-r, r + 1) for dy in range(-r, r + 1)]
    stencil = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w"))
                        for dx, dy, w in offsets])
    spread = (binned.select(*keys, "x_bin", "y_bin", "n", F.explode(stencil).alias("_o"))
                    .select(*keys, (F.col("x_bin") + F.col("_o.dx")).alias("x_bin"),
                            (F.col("y_bin") + F.col("_o.dy")).alias("y_bin"),
                            (F.col("n") * F.col("_o.w")).alias("_m")))
    dens = spread.groupBy(*keys, "x_bin", "y_bin").agg(F.sum("_m").alias("_m"))
    tot = dens.groupBy(*keys).agg(F.sum("_m").alias("_t")) if keys else None
    if keys:
        return dens.join(tot, keys).select(*keys, "x_bin", "y_bin", (F.col("_m") / F.col("_t")).alias("density"))
    total = dens.agg(F.sum("_m")).scalar()
    return dens.select("x_bin", "y_bin", (F.col("_m") / total).alias("density"))


def density_profiles(df: DataFrame, columns, y: str, by, bins: int = 32, reach: float = 3.0) -> DataFrame:
    """DS6: smoothed density of many columns against one, per group: (column, ``by``, x_bin, y_bin, x, y, density).

    For every column and group the range of both axes is cut into ``bins``; x and y are the bins' centres. The
    bandwidth of an axis is its standard deviation times n^(-1/6) (Scott's rule for two dimensions), so it follows each
    group. The Gaussian kernel is a product, so counts are spread along x and the sums along y: two passes of
    ``2 r + 1`` copies, up to ``reach`` bandwidths and thus beyond the range. ``density`` is the share in the bin; the
    shares of a column and group add up to 1. An axis of one value has one bin and is not smoothed. Rows with a missing
    x, y or NaN are left out, a null group is a group; no rows give none. All columns go through the same jobs.
    """
    keys = [by] if isinstance(by, str) else list(by)
    names = [columns] if isinstance(columns, str) else list(columns)
    g = [f"_g{i}" for i in range(len(keys))]
    long = (df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, g)], number(f"`{y}`").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), number(f"`{c}`").alias("x")) for c in names])).alias("_c"))
        .select(F.struct("_c.column", *g).alias("_key"), F.col("_c.x").alias("_x"), "_y")  # a struct's null fields join as equal
        .where("_x IS NOT NULL AND _y IS NOT NULL"))
    of = lambda c: (F.min(c).alias(f"lo{c}"), F.max(c).alias(f"hi{c}"), F.stddev_samp(c).alias(f"sd{c}"))
    stats = long.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), *of("_x"), *of("_y"))
    for c in ("_x", "_y"):
        width = (F.col(f"hi{c}") - F.col(f"lo{c}")) / F.lit(float(bins))
        stats = (stats.withColumn(f"w{c}", width)
                 .withColumn(f"bw{c}", F.when(width > 0, F.col(f"sd{c}") * F.pow(F.col("n").cast("double"), F.lit(-1 / 6))))
                 .withColumn(f"r{c}", F.coalesce(F.ceil(F.col(f"bw{c}") * reach / F.when(width > 0, width)), F.lit(0)).cast("int")))
    stats = reliable(stats)  # a row per column and group
    beside = F.broadcast(stats) if stats.count() <= BROADCAST_GROUPS else stats
    at = lambda c: F.when(F.col(f"w{c}") > 0, F.least(F.floor((F.col(c) - F.col(f"lo{c}")) / F.col(f"w{c}")), F.lit(bins - 1))).otherwise(0).cast("int")
    grid = long.join(beside, "_key").groupBy("_key", at("_x").alias("b_x"), at("_y").alias("b_y")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    for c in ("_x", "_y"):
        step = F.col("d") * F.col(f"w{c}")
        weight = F.when(F.col("d") == 0, 1.0).otherwise(F.exp(-(step * step) / (2 * F.col(f"bw{c}") * F.col(f"bw{c}"))))
        other = "b_y" if c == "_x" else "b_x"
        grid = (grid.join(beside, "_key").withColumn("d", F.explode(F.sequence(-F.col(f"r{c}"), F.col(f"r{c}"))))
                .groupBy("_key", other, (F.col(f"b{c}") + F.col("d")).alias(f"b{c}")).agg(F.sum(F.col("m") * weight).alias("m")))
    grid = reliable(grid)  # at most (bins + 2 r)^2 rows a column and group
    total = grid.groupBy("_key").agg(F.sum("m").alias("t"))
    centre = lambda c: F.col(f"lo{c}") + (F.col(f"b{c}") + F.lit(0.5)) * F.col(f"w{c}")
    return (grid.join(total, "_key").join(beside, "_key")
            .select("_key.column", *[F.col(f"_key.{n}").alias(k) for k, n in zip(keys, g)], F.col("b_x").alias("x_bin"), F.col("b_y").alias("y_bin"),
                    centre("_x").alias("x"), centre("_y").alias("y"), (F.col("m") / F.col("t")).alias("density")))


def cumulative(df: DataFrame, order_col: str, value_col: str, out_col: str = "cumulative") -> DataFrame:
    """AG13/DS8: running total in the order of a column, for any number of rows (see ``scan.running_total``)."""
    return running_total(df, order_col, value_col, out_col)
