"""Quantiles from one sketch a group (PR2, DS3): exact whatever the sketch, few rows ranked, two scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizlens.operators import distributions, profile, quantiles
from bizlens.operators.quantiles import exact_quantiles, grouped_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
NAMES = [f"p{i}" for i in range(7)]


def _frame(spark, groups):
    """(g, x) of named numpy arrays, spread over partitions."""
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, x double").repartition(7)


def _shapes():
    rng = np.random.default_rng(2)
    return {"normal": rng.normal(size=30_000), "ties": rng.integers(0, 3, 20_000), "one": np.full(9_000, 7.0),
            "far": np.concatenate([rng.normal(size=15_000), [1e300, -1e300]]), "steps": np.repeat(np.arange(40), 500),
            "few": rng.normal(size=3), "mostly": np.concatenate([np.zeros(20_000), np.arange(1, 2000)])}


@pytest.mark.parametrize("sort_rows", [0, 50, 2_000, 10 ** 9])
def test_all_shapes_are_exact(spark, sort_rows):
    shapes = _shapes()
    got = {r.g: r for r in exact_quantiles(_frame(spark, shapes), "x", PROBS, by="g", names=NAMES, sort_rows=sort_rows).collect()}
    for g, values in shapes.items():
        assert got[g].n == len(values)
        assert np.allclose([got[g][c] for c in NAMES], np.quantile(values, PROBS), rtol=1e-12, atol=0), g


def test_a_sketch_that_errs_is_found_out(spark, monkeypatch):
    """Points read as if the ranks were a tenth off: the counts tell, and the intervals widen until they hold."""
    values = np.random.default_rng(4).normal(size=20_000)
    plain = quantiles._points
    calls = []

    def off(rows, sort_rows):
        calls.append(1)
        grid = F.array(*[F.lit(min(1.0, i / quantiles.GRID + 0.1)) for i in range(quantiles.GRID + 1)])
        return F.when(rows > sort_rows, F.kll_sketch_get_quantile_double("_sketch", grid))

    monkeypatch.setattr(quantiles, "_points", off)
    got = exact_quantiles(_frame(spark, {"a": values}), "x", [0.25, 0.5], names=["p", "q"], sort_rows=15_000).first()
    assert calls and np.allclose([got.p, got.q], np.quantile(values, [0.25, 0.5]), rtol=1e-12)
    monkeypatch.setattr(quantiles, "_points", plain)


def test_intervals_keep_few_rows(spark):
    """What is ranked stays near the bound although one value holds a third of the rows."""
    values = np.concatenate([np.random.default_rng(1).normal(size=40_000), np.full(20_000, 0.25)])
    df = _frame(spark, {"a": values}).select(F.struct(F.col("g").alias("k0")).alias("_key"), F.col("x").alias("_x"))
    first = df.groupBy("_key").agg(F.count("_x").alias("_n"), quantiles._sketch()).withColumn("_grid", quantiles._points(F.col("_n"), 0))
    for p in (0.1, 0.5, 0.6, 0.9):
        lo, hi = first.select(*quantiles._ends("_grid", (F.col("_n") - 1) * p, F.lit(0), F.col("_n"), quantiles.SLACK)).first()
        assert len(np.unique(values[(values >= lo) & (values <= hi)])) < 0.012 * len(values)
        assert lo <= np.quantile(values, p) <= hi


def test_null_keys_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", float("nan")), ("b", 5.0), ("b", None)], "g string, x double")
    got = {r.g: (r.n, r.q5) for r in exact_quantiles(df, "x", [0.5], by="g").collect()}
    assert got == {None: (2, 2.0), "b": (1, 5.0)}
    assert exact_quantiles(df.limit(0), "x", [0.5], by="g").count() == 0
    assert exact_quantiles(df.limit(0), "x", [0.5]).count() == 0
    out = grouped_quantiles(df, "x", [0.5], ["g"], ["m"], also=(F.max("_x").alias("top"),))
    assert {r.g: (r.n, r.top, r.m) for r in out.collect()} == {None: (2, 3.0, 2.0), "a": (0, None, None), "b": (1, 5.0, 5.0)}


def test_describe_is_two_scans(spark, tmp_path):
    """An accumulator beside every row tells how often the input is read."""
    df = spark.range(3000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).alias("y"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = df.mapInArrow(count, df.schema)
    rows = {r["column"]: r for r in profile.describe(counted, ["x", "y"]).collect()}
    assert seen.value == 2 * 3000
    assert (rows["x"]["q25"], rows["x"]["q50"], rows["y"]["q75"], rows["y"]["max"]) == (749.75, 1499.5, 5.0, 6.0)
    approx = {r["column"]: r for r in profile.describe(df, ["x", "y"], method="approx").collect()}
    assert abs(approx["x"]["q50"] - 1499.5) <= 3 and approx["x"]["count"] == 3000


def test_box_of_a_group_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 100.0), ("b", None)], "g string, x double")
    out = {r.g: r for r in distributions.box_stats(df, "x", "g").collect()}
    assert set(out) == {"a"} and out["a"].n_outliers == 0 and out["a"].median == 2.0
