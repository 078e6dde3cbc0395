"""PR5, DS6, SC4/DS5, ML5, RP14: correlation by Gram sums, densities, samples, coreset."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from bizlens.operators import distributions, profile, segments
from bizlens.sources.samples import sample_per_group, sample_rows


def test_correlation_of_fifty_columns_with_missing_values(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(400, 50)) @ rng.normal(size=(50, 50)) + 1e6
    data[rng.random(data.shape) < 0.2] = np.nan
    data[:, 7], data[:, 9] = 3.3, np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(r)) for r in data],
                               ", ".join(f"c{i} double" for i in range(50)))
    got = {(r.column_a, r.column_b): r["corr"] for r in profile.correlation(df, digits=None).collect()}
    assert len(got) == 2500
    for i in range(50):
        for j in range(50):
            both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            x, y = data[both, i], data[both, j]
            if both.sum() < 2 or np.ptp(x) == 0 or np.ptp(y) == 0:
                assert got[f"c{i}", f"c{j}"] is None
            else:
                assert got[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    plan = profile.correlation(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2 and "SinglePartition" not in plan


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1, 2.0), (None, 3.0)], "`a.b` int, c double")
    assert {r["corr"] for r in profile.correlation(df).collect()} == {None, 1.0}  # two values of c, one of a.b
    empty = {r["corr"] for r in profile.correlation(df.limit(0)).collect()}
    assert empty <= {None}


def _dense(points, bins, reach=3.0):
    """Density of one group by all pairs of bins."""
    x, y = points[:, 0], points[:, 1]
    out, axes = {}, []
    for v in (x, y):
        w = (v.max() - v.min()) / bins
        bw = v.std(ddof=1) * len(v) ** (-1 / 6) if w > 0 else 0
        axes.append((v.min(), w, bw, int(np.ceil(bw * reach / w)) if w > 0 else 0))
    at = lambda v, a: min(int((v - a[0]) / a[1]), bins - 1) if a[1] > 0 else 0
    for p, q in zip(x, y):
        i, j = at(p, axes[0]), at(q, axes[1])
        for d in range(-axes[0][3], axes[0][3] + 1):
            for e in range(-axes[1][3], axes[1][3] + 1):
                k = [np.exp(-(s * a[1]) ** 2 / (2 * a[2] ** 2)) if s else 1.0 for s, a in ((d, axes[0]), (e, axes[1]))]
                out[i + d, j + e] = out.get((i + d, j + e), 0) + k[0] * k[1]
    total = sum(out.values())
    return {b: m / total for b, m in out.items()}


def test_density_profiles(spark):
    """Two passes of one dimension against the kernel of both; groups with their own bandwidth, constant and missing values."""
    rng = np.random.default_rng(3)
    rows = [(g, float(rng.normal(0, s)), 5.0, float(rng.normal(10, 2 * s))) for g, s, n in (("a", 1, 150), (None, 4, 90)) for _ in range(n)]
    rows += [("a", None, 1.0, None), ("b", 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, `x.1` double, flat double, y double")
    got = {}
    for r in distributions.density_profiles(df, ["x.1", "flat"], "y", "g", bins=8).collect():
        got.setdefault((r.column, r.g), {})[r.x_bin, r.y_bin] = r.density
    for column, at in (("x.1", 1), ("flat", 2)):
        for g in ("a", None, "b"):
            points = np.array([(r[at], r[3]) for r in rows if r[0] == g and r[at] is not None and r[3] is not None])
            want = _dense(points, 8)
            assert got[column, g].keys() == want.keys()
            assert all(abs(got[column, g][b] - want[b]) < 1e-12 for b in want) and sum(want.values()) == pytest.approx(1)
    assert distributions.density_profiles(df.limit(0), ["flat"], "y", "g").count() == 0


def test_exact_sizes_for_any_partitions(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 60 == 0, None).otherwise((F.col("id") % 7).cast("string")).alias("g"))
    a, b = ({tuple(r) for r in sample_per_group(df.repartition(n), "g", 25, "id", seed=3).collect()} for n in (1, 17))
    assert a == b
    sizes = {r.g: r["count"] for r in sample_per_group(df, "g", 25, "id").groupBy("g").count().collect()}
    assert set(sizes.values()) == {25} and None in sizes and len(sizes) == 9
    assert sample_per_group(df, "g", 10_000, "id").count() == 6000 and sample_per_group(df.limit(0), "g", 5, "id").count() == 0
    assert {tuple(r) for r in sample_per_group(df, "g", 25, "id", seed=4).collect()} != a
    plan = sample_per_group(df, "g", 25, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1
    first = [r.id for r in sample_rows(df, 12, key="id").collect()]
    assert first == [r.id for r in sample_rows(df.repartition(9), 12, key="id").collect()] and len(set(first)) == 12


def _blobs(n, seed=1):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.4, (n // 4, 2)) for c in ((0, 0), (5, 0), (0, 5), (6, 6))])


def test_sweep_on_a_coreset_finds_the_elbow(spark):
    """A sample of a tenth: the elbow of full fits, and distortions of all rows close to theirs."""
    points = _blobs(8000)
    df = spark.createDataFrame([([float(v) for v in p],) for p in points], "vec array<double>").select(array_to_vector("vec").alias("features"))
    some = segments.kmeans_sweep(df, ks=range(2, 8), size=800).collect()
    full = segments.kmeans_sweep(df, ks=range(2, 8), size=None).collect()
    assert [r.k for r in some if r.is_elbow] == [r.k for r in full if r.is_elbow] == [4]
    for a, b in zip(some, full):
        assert a.distortion <= 1.1 * b.distortion
    at4 = [r.distortion for r in some if r.k == 4][0]
    centres = np.array([points[i * 2000:(i + 1) * 2000].mean(axis=0) for i in range(4)])
    assert at4 == pytest.approx(((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum(), rel=0.01)


def test_coreset_weights(spark):
    """Weights add up to the rows, costs of any centres stay close, and few rows are all taken."""
    points = np.concatenate([_blobs(20_000, 5), [[60.0, 60.0]]])
    df = spark.createDataFrame([([float(v) for v in p],) for p in points], "vec array<double>")
    drawn = segments.coreset(df, F.col("vec"), 1500).collect()
    x, w = np.array([r.features.toArray() for r in drawn]), np.array([r.weight for r in drawn])
    assert 1000 < len(x) < 2000 and w.sum() == pytest.approx(len(points), rel=0.1)
    rng = np.random.default_rng(0)
    for k in (1, 3, 6):
        c = rng.uniform(0, 6, (k, 2))
        cost = lambda p: ((p[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)  # noqa: E731,B023
        assert (cost(x) * w).sum() == pytest.approx(cost(points).sum(), rel=0.15)
    few = segments.coreset(df.limit(300), F.col("vec"), 600).collect()
    assert len(few) == 300 and {r.weight for r in few} == {1.0}
    same = spark.createDataFrame([([1.0, 1.0],)] * 50, "vec array<double>")
    assert {r.distortion for r in segments.kmeans_sweep(same, "vec", ks=range(1, 4)).collect()} == {0.0}
    none = segments.kmeans_sweep(same.limit(0), "vec", ks=range(2, 4)).collect()
    assert [(r.distortion, r.is_elbow) for r in none] == [(None, False)] * 2


def test_profile_densities_compute_the_bookings_once_for_both_passes(spark):
    from pyspark.sql import functions as F

    from bizlens.plans import bookings as bk
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def price(i):
        read.add(1)
        return float(i % 17)

    rows = spark.range(400).select(F.col("id").alias(bk.KEY), (F.col("id") % 3).alias("no_of_items"), (F.col("id") % 7).alias("lead_time"),
                                   price.asNondeterministic()("id").alias(bk.PRICE))
    cols = bk.BookingColumns(categorical=("no_of_items",), date_parts=(), profile=("no_of_items", "lead_time"))
    segments = spark.range(390).select(F.col("id").alias(bk.KEY), (F.col("id") % 2).alias("Segment"))
    out = bk.profile_densities(rows, segments, cols, bins=4).collect()
    assert abs(sum(r.density for r in out if r.column == "lead_time" and r.Segment == 1) - 1) < 1e-9
    assert read.value == 400
