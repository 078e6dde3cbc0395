"""ML11: the forest on binned features, with nodes above and below the rows of one task."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from bizlens.operators import classify, forest


def _rows(spark, n=6000):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 9))
    x[:, 4:] = x[:, 4:] > 0.5
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)) | (x[:, 5] * x[:, 6] > 0)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))],
                               "id long, vec array<double>, label double").repartition(5)
    return df.withColumn("features", array_to_vector("vec")).drop("vec")


@pytest.mark.parametrize("local", [32_768, 300])
def test_forest_learns_with_nodes_of_any_size(spark, monkeypatch, local):
    monkeypatch.setattr(forest, "LOCAL", local)
    df = _rows(spark)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    model = classify.fit_forest(train, trees=12)
    out = model.transform(test)
    assert out.columns == [*test.columns, "prediction"] and out.count() == test.count()
    assert classify.binary_metrics(out, positive=1.0).first()["accuracy"] > 0.95
    # the rows of every tree end in a table of subtrees, not on the driver
    assert model.subtrees.count() == sum(int((o >= 0).sum()) for o in model.owners) >= 12 * (1 if local > 6000 else 5)
    # a full tree on one feature set at most errs where bootstrap left rows out
    assert classify.binary_metrics(model.transform(train), positive=1.0).first()["accuracy"] > 0.98


def test_subtree_splits_by_gini():
    x = np.array([[0, 3], [1, 3], [2, 3], [3, 3]], np.uint8)
    feature, cut, below, p = forest._grow(x, np.array([0, 0, 1, 1]), np.ones(4), 2, 2, 30, np.random.default_rng(0))
    assert feature.tolist() == [0, -1, -1] and (cut[0], below[0]) == (1, 1) and p[1:].tolist() == [[1, 0], [0, 1]]
    flat = forest._grow(x, np.array([0, 0, 1, 1]), np.ones(4), 2, 2, 0, np.random.default_rng(0))
    assert flat[0].tolist() == [-1] and flat[3].tolist() == [[0.5, 0.5]]


def test_forest_needs_labels(spark):
    df = _rows(spark, 40)
    for bad in (df.limit(0), df.withColumn("label", F.when(F.col("id") > 3, F.col("label")))):
        with pytest.raises(ValueError, match="label"):
            classify.fit_forest(bad, trees=2)


def test_rows_alike_are_held_once(spark, monkeypatch):
    """Rows with the same bins and label are one row with a count, in the fit and in the prediction."""
    held, write = {}, forest.materialise
    monkeypatch.setattr(forest, "materialise", lambda df, name: held.setdefault(name, write(df, name)))
    df = spark.range(3000).withColumn("label", (F.col("id") % 3 == 0).cast("double")).withColumn(
        "features", array_to_vector(F.array(*[((F.col("id") % 30) % k).cast("double") for k in (2, 3, 5)])))
    out = classify.fit_forest(df, trees=6).transform(df)
    assert out.count() == 3000 and classify.binary_metrics(out, positive=1.0).first()["accuracy"] > 0.99
    blocks = held["blocks"].collect()
    assert sum(len(r.x) for r in blocks) == 30 * 3
    assert sum(np.frombuffer(r.n, np.int64).sum() for r in blocks) == 3000


def test_draws_are_poisson():
    w = forest._drawn(np.random.default_rng(0), np.ones(200_000, np.int64))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    many = forest._drawn(np.random.default_rng(0), np.full(50_000, 40))
    assert abs(many.mean() - 40) < 0.2 and abs(many.var() - 40) < 1.5


def test_best_split_of_every_node_is_that_of_all_cuts():
    rng = np.random.default_rng(3)
    widths = np.array([5, 2, 7, 1])
    x, y, w = np.stack([rng.integers(0, k, 400) for k in widths], axis=1).astype(np.uint8), rng.integers(0, 3, 400), rng.integers(1, 4, 400)
    at = np.sort(rng.integers(0, 6, 400))
    chosen = forest._subset(rng, 6, 4, 3)
    assert all(len(set(c)) == 3 for c in chosen.tolist())
    first, bins = forest._first_bins(chosen, widths)
    j, b, gains, left, right = forest._best(forest._histograms(at, x, y, w, chosen, first, bins, 3), chosen, first, widths)
    pure = lambda k: sum(w[k & (y == c)].sum() ** 2 for c in range(3)) / w[k].sum()
    for i in range(6):
        cuts = {(f, v): pure(here & (x[:, c] <= v)) + pure(here & (x[:, c] > v)) for here in [at == i] for f, c in enumerate(chosen[i])
                for v in range(widths[c]) if (here & (x[:, c] <= v)).any() and (here & (x[:, c] > v)).any()}
        assert gains[i] and np.isclose(cuts[j[i], b[i]], max(cuts.values()))
        inside = (at == i) & (x[:, chosen[i, j[i]]] <= b[i])
        assert left[i].tolist() == [w[inside & (y == c)].sum() for c in range(3)]
        assert (left[i] + right[i]).sum() == w[at == i].sum()


def test_bins_in_bits():
    x = np.random.default_rng(1).integers(0, [2, 9, 2, 2, 30, 1], (50, 6)).astype(np.uint8)
    widths = np.array([2, 9, 2, 2, 30, 1])
    assert (forest._spread(forest._squeeze(x, widths), widths) == x).all() and forest._squeeze(x, widths).shape[1] == 3
