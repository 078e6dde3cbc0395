"""ML6: CF-trees and Ward's clustering against the exact method."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from bizlens.operators import cftree, segments


def rand_index(a, b):
    """Adjusted Rand index of two labelings."""
    table = np.zeros((max(a) + 1, max(b) + 1))
    np.add.at(table, (np.asarray(a), np.asarray(b)), 1)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    both, rows, columns, all_ = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), pairs(table.sum())
    expected = rows * columns / all_
    return (both - expected) / ((rows + columns) / 2 - expected)


def greedy_ward(points, weights, k):
    """The definition: merge the cheapest pair of clusters until k are left."""
    groups = [[i] for i in range(len(points))]

    def cost(a, b):
        wa, wb = weights[a].sum(), weights[b].sum()
        gap = np.average(points[a], axis=0, weights=weights[a]) - np.average(points[b], axis=0, weights=weights[b])
        return wa * wb / (wa + wb) * gap @ gap

    while len(groups) > k:
        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    label = np.empty(len(points), int)
    for g, members in enumerate(groups):
        label[members] = g
    return label


def clouds(n, seed=5):
    """Four clouds of different size and shape, and scattered points."""
    rng = np.random.default_rng(seed)
    share = [n * 5 // 10, n * 2 // 10, n * 15 // 100]
    parts = [rng.normal((0, 0), (1.0, 0.5), (share[0], 2)), rng.normal((6, 1), (0.5, 1.2), (share[1], 2)),
             rng.normal((1, 7), 0.8, (share[2], 2)), rng.normal((8, 8), 0.6, (n - sum(share) - n // 50, 2)),
             rng.uniform(-2, 10, (n // 50, 2))]
    return np.concatenate(parts)


def frame(spark, points, parts=6):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(parts, "id")


@pytest.mark.parametrize("k", [2, 4, 9])
def test_chain_equals_greedy_ward(k):
    rng = np.random.default_rng(k)
    points, weights = rng.normal(size=(45, 3)), rng.integers(1, 9, 45).astype(float)
    got = cftree.ward_chain(points, weights, k)
    assert len(set(got)) == k and rand_index(got, greedy_ward(points, weights, k)) == 1
    assert set(cftree.ward_chain(points, weights, 1)) == {0}
    sizes = np.bincount(got, weights)
    assert (np.diff(sizes) <= 0).all()


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 400), st.integers(1, 4), st.sampled_from([0.0, 0.2, 1.0]), st.sampled_from([3, 40, 1000]), st.integers(0, 99))
def test_tree_keeps_counts_and_the_bound(n, d, radius, most, seed):
    points = np.round(np.random.default_rng(seed).normal(size=(n, d)), 1)
    tree = cftree.Tree(d, radius, most)
    tree.insert(*cftree._cells(points, radius))
    count, s, ss = tree.features()
    assert len(count) == tree.leaves <= most and count.sum() == n
    assert np.allclose(s.sum(axis=0), points.sum(axis=0)) and np.isclose(ss.sum(), (points ** 2).sum())
    spread = ss / count - ((s / count[:, None]) ** 2).sum(axis=1)
    assert (spread <= tree.radius ** 2 + 1e-9).all()
    if tree.radius == radius == 0:
        assert len(count) == len(np.unique(points, axis=0))


def test_agrees_with_exact_ward(spark):
    """Bounded leaves against the clustering of all points, and exact with a bound of 0."""
    points = clouds(1500)
    exact = cftree.ward_chain(points, np.ones(len(points)), 4)
    df = frame(spark, points)
    leaves = cftree.summarise(df, F.col("vec"))
    assert 50 < len(leaves.counts) < 900 and leaves.counts.sum() == len(points)
    assert (leaves.inside <= leaves.counts * leaves.radius ** 2 + 1e-9).all()
    for options in ({}, {"radius": 0.1}, {"micro_clusters": 60}):
        got = dict(segments.hierarchical_segments(df, "vec", 4, **options).select("id", "Segment").collect())
        assert rand_index([got[i] for i in range(len(points))], exact) >= 0.9
    got = dict(segments.hierarchical_segments(df, "vec", 4, radius=0.0).select("id", "Segment").collect())
    assert rand_index([got[i] for i in range(len(points))], exact) == 1


def test_leaves_follow_the_bound_not_the_rows(spark):
    few = [len(cftree.summarise(frame(spark, clouds(n)), F.col("vec"), r).counts) for n, r in ((2000, 0.1), (20_000, 0.1), (20_000, 0.05))]
    assert few[1] < 2 * few[0] and few[2] > 2 * few[1]


def test_partitions_do_not_change_segments(spark):
    points = clouds(3000, seed=8)
    a, b = (dict(segments.hierarchical_segments(frame(spark, points, n), "vec", 4).select("id", "Segment").collect()) for n in (1, 40))
    assert rand_index([a[i] for i in range(3000)], [b[i] for i in range(3000)]) >= 0.95


def test_segment_edges(spark):
    """Null, incomplete and infinite vectors have no segment; few, equal and no rows; a clashing name is replaced."""
    rows = [(1, [0.0, 0.0], 9), (2, [0.0, 0.0], 9), (3, [5.0, 5.0], 9), (4, None, 9), (5, [1.0, float("nan")], 9),
            (6, [None, 1.0], 9), (7, [float("inf"), 1.0], 9)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, Segment int")
    got = dict(segments.hierarchical_segments(df, "vec", 4).select("id", "Segment").collect())
    assert got == {1: 0, 2: 0, 3: 1, 4: None, 5: None, 6: None, 7: None}
    assert segments.hierarchical_segments(df.limit(0), "vec", 4).count() == 0
    same = df.where("id < 3").withColumn("v", array_to_vector("vec"))
    assert {r.Segment for r in segments.hierarchical_segments(same, "v", 4).collect()} == {0}
    plan = segments.hierarchical_segments(df, "vec", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
