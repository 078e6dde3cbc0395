"""Clustering and segment profiles (ML5, ML6, ML14)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.operators import cftree
from bizlens.session import reliable

#: Leaves of a summary at most: they are clustered on the driver and sent to the tasks.
MAX_LEAVES = 5_000
#: Rows of the sample that a sweep over k fits on, about.
CORESET = 10_000
#: Starts of every fit of a sweep.
STARTS = 2


def coreset(df: DataFrame, vector: Column, size: int = CORESET, seed: int = 42) -> DataFrame:
    """``features`` and ``weight``: a weighted sample on which the cost of any centres is close to that on all rows.

    A row is drawn with probability ``size * (1 / (2 n) + d^2 / (2 D))``, at most 1, and weighs its inverse;
    d is its distance from the mean, D the sum of all d^2. For m rows drawn of n, the cost of k centres in d dimensions
    errs by at most a share e of (its own cost + D), with e^2 of the order of d k log k / m (Bachem et al. 2018). Up to
    ``size / 2`` rows are all taken, with weight 1. One aggregation finds the mean, one more pass draws; the sample is written.
    """
    x = df.select(vector.alias("x")).where("x IS NOT NULL")
    m = (x.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("mean"), F.sum("col").alias("s"),
                                                       F.count("col").alias("n"), F.var_pop("col").alias("var")).orderBy("pos").collect())
    if not m:
        return df.sparkSession.createDataFrame([], "features array<double>, weight double").select(
            array_to_vector("features").alias("features"), "weight")
    n, total = m[0]["n"], sum(r["var"] for r in m) * m[0]["n"]
    mean = F.array(*[F.lit(float(r["mean"])) for r in m])
    away = F.aggregate(F.zip_with("x", mean, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    share = F.lit(0.5 / n) + (away * F.lit(0.5 / total) if total > 0 else F.lit(0.5 / n))
    drawn = x.withColumn("p", F.least(F.lit(1.0), F.lit(float(size)) * share)).where(F.rand(seed) < F.col("p"))
    # a fit makes many short passes over the sample: few partitions, so that they are not all scheduling
    drawn = drawn.select(array_to_vector("x").alias("features"), (1 / F.col("p")).alias("weight"))
    return reliable(drawn.repartition(1 + size // 20_000))


def kmeans_sweep(df: DataFrame, features_col: str = "features", ks=range(2, 11), seed: int = 42,
                 max_iter: int = 300, parallel_fits: int = 9, size: int | None = CORESET) -> DataFrame:
    """ML5: distortion (sum of squared distances to the nearest centre) per k,
    and the elbow: the k farthest from the chord joining the first and last
    points of the (k, distortion) curve.

    All fits share one weighted ``coreset`` of about ``size`` rows (None: every fit reads all rows); their
    centres are then measured on all rows together, in one pass, so the distortions are those of the data.
    Only k centres per fit and a sum per k reach the driver. No rows give no distortion and no elbow.
    """
    ks = list(ks)
    x = vector_to_array(features_col) if isinstance(df.schema[features_col].dataType, VectorUDT) else F.col(f"`{features_col}`")
    if size is None:
        sample = df.select(array_to_vector(x).alias("features"), F.lit(1.0).alias("weight"))
    else:
        sample = coreset(df, x, size, seed)
    some = sample.limit(1).count()

    def centres(k: int) -> np.ndarray:
        if k == 1:  # the mean of all rows; the estimator takes two clusters or more
            mean = df.select(F.posexplode(x)).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()
            return np.array([[r["m"] for r in mean]])
        # a start can end in a poor optimum: the best of some
        fits = [KMeans(k=k, seed=seed + i, featuresCol="features", weightCol="weight", maxIter=max_iter, initMode="k-means||").fit(sample)
                for i in range(STARTS)]
        return np.array(min(fits, key=lambda m: m.summary.trainingCost).clusterCenters())

    # the fits are independent: submit them together so small fits share the cluster
    with ThreadPoolExecutor(max_workers=min(parallel_fits, len(ks))) as pool:
        found = list(pool.map(centres, ks)) if some else []

    @F.arrow_udf("array<double>")
    def distances(vectors: pa.Array) -> pa.Array:
        points = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        near = np.stack([((points[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1) if len(points) else np.zeros(0) for c in found], axis=1)
        return pa.ListArray.from_arrays(np.arange(len(near) + 1, dtype=np.int32) * len(found), near.ravel())

    costs = [None] * len(ks)
    if some:
        sums = (df.select(x.alias("x")).where("x IS NOT NULL").select(distances("x").alias("d"))
                .agg(*[F.sum(F.col("d")[i]).alias(f"c{i}") for i in range(len(ks))]).first())
        costs = [float(sums[f"c{i}"]) for i in range(len(ks))]
    elbow = ks[0] if some else None
    if some and len(ks) > 2 and costs[0] != costs[-1]:
        at, y = np.array(ks, dtype=float), np.array(costs)
        xn = (at - at[0]) / (at[-1] - at[0])
        yn = (y - y[-1]) / (y[0] - y[-1])
        elbow = ks[int(np.argmax(np.abs(yn - (1 - xn))))]  # distance to the chord (up to a constant)
    rows = [(int(k), c, bool(k == elbow)) for k, c in zip(ks, costs)]
    return df.sparkSession.createDataFrame(rows, "k int, distortion double, is_elbow boolean")


def hierarchical_segments(df: DataFrame, features_col: str = "features", n_clusters: int = 4,
                          micro_clusters: int = MAX_LEAVES, seed: int = 42, out_col: str = "Segment",
                          radius: float = 0.05) -> DataFrame:
    """ML6: hierarchical (Ward) segmentation that scales; adds ``out_col``, 0 for the largest segment.

    Exact agglomerative clustering needs all pairs of rows. Here CF-trees summarise the rows as leaves whose
    points lie within ``radius`` (a share of the data's spread, see ``cftree.summarise``), so the bound and not the
    number of rows decides how many there are, ``micro_clusters`` at most. Ward's clustering of the weighted
    leaves is exact, and every row takes the label of the leaf nearest to it where it is, without a shuffle. With
    ``radius=0`` and no more distinct rows than ``micro_clusters`` the result is the exact clustering.

    Rows without a finite vector get a null label; fewer distinct rows than ``n_clusters`` give as many
    segments as there are; no rows give none. Nothing is drawn, so ``seed`` has no effect (it is kept for callers).
    """
    x = vector_to_array(features_col) if isinstance(df.schema[features_col].dataType, VectorUDT) else F.col(f"`{features_col}`")
    leaves = cftree.summarise(df, x, radius, micro_clusters)
    labels = cftree.ward_chain(leaves.centres, leaves.counts, n_clusters)
    return df.withColumn(out_col, cftree.nearest(x, leaves, labels))


def segment_profile(df: DataFrame, segment_col: str, price_col: str, target_col: str) -> DataFrame:
    """ML14: per segment the mean price and the row count."""
    return (df.groupBy(segment_col)
              .agg(F.avg(price_col).alias("avg_price"), F.count(target_col).alias("n"))
              .orderBy(segment_col))


def segment_target_mix(df: DataFrame, segment_col: str, target_col: str) -> DataFrame:
    """ML14/AG11: counts per (segment, target value)."""
    return df.groupBy(segment_col, target_col).agg(F.count(F.lit(1)).alias("n"))
