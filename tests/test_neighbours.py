"""JN8, ML8: neighbours over every labelled row against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizlens.operators import classify, neighbours
from bizlens.operators.neighbours import nearest_rows


def _frame(spark, points, labels=None):
    rows = [(i, [float(x) for x in p], float(i % 3 if labels is None else labels[i])) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, vec array<double>, label double").repartition(5)


def _brute(train, queries, k):
    """{query id: [(neighbour id, distance)]}"""
    ids, x = np.array([i for i, _ in train]), np.array([p for _, p in train])
    out = {}
    for i, q in queries:
        gap = ((x - q) ** 2).sum(axis=1)
        order = np.lexsort((ids, gap))[:k]
        out[i] = [(int(ids[o]), float(gap[o])) for o in order]
    return out


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.neighbour_id, r.distance2))
    return out


def _shapes():
    rng = np.random.default_rng(6)
    plane = rng.normal(size=(2500, 2))
    wide = rng.normal(size=(900, 12))
    clumps = np.concatenate([rng.normal(c, 0.05, (400, 4)) for c in rng.uniform(-5, 5, (5, 4))])
    grid = rng.integers(0, 6, (2000, 3)).astype(float)  # ties and equal vectors everywhere
    hot = np.concatenate([np.full((900, 2), 1.5), rng.normal(size=(1500, 2)) * [1, 1000]])
    line = rng.exponential(size=(1500, 1))
    return {"plane": plane, "wide": wide, "clumps": clumps, "grid": grid, "hot": hot, "line": line}


@pytest.mark.parametrize("shape", sorted(_shapes()))
def test_every_neighbour_is_found(spark, shape, monkeypatch):
    """Exact on small cells and blocks: many cells, far probes, hot cells in several blocks."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "SAMPLE", 40)
    points = _shapes()[shape]
    df = _frame(spark, points)
    got = _found(nearest_rows(df.where("id % 4 > 0"), df.where("id % 4 = 0"), 5, vec_col="vec"))
    split = lambda keep: [(i, p) for i, p in enumerate(points) if keep(i % 4)]
    want = _brute(split(lambda m: m > 0), split(lambda m: m == 0), 5)
    assert {q: [n for n, _ in r] for q, r in got.items()} == {q: [n for n, _ in r] for q, r in want.items()}
    assert all(np.allclose([d for _, d in got[q]], [d for _, d in want[q]], rtol=1e-12) for q in want)


def test_recall_with_few_probes(spark, monkeypatch):
    """Clumps in eight dimensions, four cells besides its own for every query."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(c, 0.3, (250, 8)) for c in rng.uniform(-5, 5, (12, 8))])
    df = _frame(spark, points)
    train, test = [(i, p) for i, p in enumerate(points) if i % 5], [(i, p) for i, p in enumerate(points) if i % 5 == 0]
    got = _found(nearest_rows(df.where("id % 5 > 0"), df.where("id % 5 = 0"), 5, vec_col="vec", probes=4))
    want = _brute(train, test, 5)
    hits = sum(len({n for n, _ in got[q]} & {n for n, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_edges(spark):
    """Missing vectors, null ids and labels, equal rows, fewer rows than k, no rows, clashing names."""
    rows = [(1, [0.0, 0.0], 1.0, 5), (2, [0.0, 0.0], None, 5), (2, [0.0, 0.0], None, 5), (3, [4.0, 3.0], 1.0, 5), (4, None, 0.0, 5),
            (5, [float("nan"), 1.0], 0.0, 5), (6, [None, 1.0], 0.0, 5), (None, [1.0, 1.0], 0.0, 5)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label double, cell int")
    got = _found(nearest_rows(df, df, 4, vec_col="vec"))
    assert got == {1: [(1, 0), (2, 0), (2, 0), (3, 25)], 2: [(1, 0), (2, 0), (2, 0), (3, 25)], 3: [(3, 0), (1, 25), (2, 25), (2, 25)]}
    assert nearest_rows(df.limit(0), df, 2, vec_col="vec").count() == 0 == nearest_rows(df, df.limit(0), 2, vec_col="vec").count()


def test_votes_of_all_rows(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(1200, 2))
    labels = (points[:, 0] > 0).astype(int)
    df = _frame(spark, points, labels)
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    pred = classify.knn_predict(train, test, 5, "id", "vec", "label", fit_rows=None)
    assert pred.count() == test.count() and classify.binary_metrics(pred, positive=1.0).first().accuracy > 0.97
    some = classify.knn_predict(train, test, 5, "id", "vec", "label")
    assert {(r.id, r.prediction) for r in some.collect()} == {(r.id, r.prediction) for r in pred.collect()}


def test_labelled_rows_are_joined_not_broadcast(spark, monkeypatch):
    """Whatever Spark broadcasts of its own is a table of cells: the search itself cogroups."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = _frame(spark, np.random.default_rng(0).normal(size=(300, 2)))
        plan = nearest_rows(df, df, 2, vec_col="vec")._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInPandas" in plan and "Broadcast" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_block_search_memory_does_not_follow_the_labelled_rows():
    import tracemalloc

    import numpy as np
    from bizlens.operators.classify import _block_topk
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(30_000, 4)), rng.normal(size=(600, 4))
    x[::3] = x[0]  # a third of the rows are alike: ties by the smaller id
    q[:5] = x[0]
    ids = rng.permutation(len(x))
    tracemalloc.start()
    found = [np.concatenate(c) for c in _block_topk(np.arange(len(q)), q, ids, x, np.zeros(len(x)), 5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    for i in (0, 4, 5, 599):
        d = ((x - q[i]) ** 2).sum(axis=1)
        assert found[1][i * 5:i * 5 + 5].tolist() == ids[np.lexsort((ids, d))[:5]].tolist()


def test_knn_vote_query_searches_every_labelled_row(spark, tmp_path):
    """More labelled rows than the query once fitted on; nearest of all of them decide."""
    from bizlens.plans.catalog import QUERIES
    rng = np.random.default_rng(12)
    n = 32_000
    points, labels = rng.normal(size=(n, 3)).astype(np.float32), rng.integers(0, 6, n)
    df = spark.createDataFrame([(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(points, labels))],
                               "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r.prediction for r in QUERIES["knn_vote"](spark, str(tmp_path)).collect()}
    ids = np.arange(n)
    train, x = ids[ids % 10 >= 3], points.astype(float)
    assert sorted(got) == ids[ids % 10 < 3].tolist()
    for i in range(0, n, 70):
        gap = ((x[train] - x[i]) ** 2).sum(axis=1)
        votes = np.bincount(labels[train[np.lexsort((train, gap))[:5]]])
        assert got[i] == votes.argmax()


def test_grid_follows_the_spread():
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(1000, 8)) * [0.3, 0.3, 40, 0.3, 4000, 0.3, 0.3, 0.3]
    axes = neighbours._directions(flat, 3)
    assert abs(axes[4, 0]) > 0.99 and abs(axes[2, 1]) > 0.99
    ranges = neighbours._grid(flat, axes, 1_000_000, 5)
    assert ranges[0] > 10 * ranges[1] and ranges[2] == 1
    wide = rng.normal(size=(1000, 64))  # no bound of a query keeps it from any cell
    assert neighbours._grid(wide, neighbours._directions(wide, 3), 100_000, 5) == [1, 1, 1]
