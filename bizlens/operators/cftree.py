"""Clustering features: a bounded summary of any number of points for clustering (ML6).

A clustering feature is (count, sum, sum of squared lengths) of some points. Features add, so summaries of
parts of a table can be merged in any order. Every task builds a CF-tree of its rows: points of one grid cell are
added first, then the cells are inserted from the root to the nearest leaf entry, which takes a cell in as long as
its radius (root mean square distance from its centre) stays within the bound. The tasks' leaves meet in
a tree of merges. The bound decides the number of leaves, not the number of rows; when a task would hold more
than ``max_leaves``, it widens its bound and inserts its leaves anew, as does every merge after it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.session import reliable

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no installed package

#: Entries of a tree node; factor by which a full tree widens its bound; summaries that a merge takes at a time.
BRANCHES, WIDEN, FAN_IN = 32, 1.3, 16
#: Grid cells that a task gathers before it inserts them.
CELLS = 20_000
SCHEMA = "part int, radius double, n long, s array<double>, ss double"


class _Node:
    """Up to BRANCHES features: leaf entries, or sums of the nodes below."""

    __slots__ = ("n", "s", "ss", "size", "below")

    def __init__(self, d: int, leaf: bool) -> None:
        self.n, self.s, self.ss = np.zeros(BRANCHES + 1), np.zeros((BRANCHES + 1, d)), np.zeros(BRANCHES + 1)
        self.size, self.below = 0, None if leaf else []

    def nearest(self, centre: np.ndarray) -> int:
        away = self.s[:self.size] / self.n[:self.size, None] - centre
        return int(np.argmin(np.einsum("ij,ij->i", away, away)))

    def append(self, n: float, s: np.ndarray, ss: float, below: "_Node | None" = None) -> None:
        i = self.size
        self.n[i], self.s[i], self.ss[i] = n, s, ss
        self.size += 1
        if below is not None:
            self.below.append(below)

    def total(self) -> tuple[float, np.ndarray, float]:
        k = self.size
        return self.n[:k].sum(), self.s[:k].sum(axis=0), self.ss[:k].sum()

    def split(self) -> "tuple[_Node, _Node]":
        """Two nodes around the two entries that are farthest apart."""
        k = self.size
        c = self.s[:k] / self.n[:k, None]
        gap = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        a, b = divmod(int(np.argmax(gap)), k)
        to_b = gap[:, b] < gap[:, a]
        to_b[a], to_b[b] = False, True
        out = _Node(self.s.shape[1], self.below is None), _Node(self.s.shape[1], self.below is None)
        for i in range(k):
            out[int(to_b[i])].append(self.n[i], self.s[i], self.ss[i], None if self.below is None else self.below[i])
        return out


class Tree:
    """A CF-tree of points given as features, with at most ``max_leaves`` leaf entries."""

    def __init__(self, d: int, radius: float, max_leaves: int) -> None:
        self.d, self.radius, self.max_leaves = d, radius, max_leaves
        self.root, self.leaves = _Node(d, True), 0

    def insert(self, n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> None:
        for i in range(len(n)):
            self._one(float(n[i]), s[i], float(ss[i]))
            if self.leaves > self.max_leaves:
                self._widen()

    def _one(self, n: float, s: np.ndarray, ss: float) -> None:
        path, node, centre = [], self.root, s / n
        while node.below is not None:
            i = node.nearest(centre)
            path.append((node, i))
            node = node.below[i]
        if node.size:
            i = node.nearest(centre)
            m, t, tt = node.n[i] + n, node.s[i] + s, node.ss[i] + ss
            mean = t / m
            if tt / m - mean @ mean <= self.radius ** 2:
                node.n[i], node.s[i], node.ss[i] = m, t, tt
                for up, j in path:
                    up.n[j] += n
                    up.s[j] += s
                    up.ss[j] += ss
                return
        node.append(n, s, ss)
        self.leaves += 1
        for up, j in path:
            up.n[j] += n
            up.s[j] += s
            up.ss[j] += ss
        while node.size > BRANCHES:
            a, b = node.split()
            if not path:
                self.root = _Node(self.d, False)
                self.root.append(*a.total(), a)
                self.root.append(*b.total(), b)
                return
            up, j = path.pop()
            up.n[j], up.s[j], up.ss[j] = a.total()
            up.below[j] = a
            up.append(*b.total(), b)
            node = up

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, sums, sums of squares) of the leaf entries."""
        found, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node.below is None:
                found.append((node.n[:node.size], node.s[:node.size], node.ss[:node.size]))
            else:
                todo += node.below
        return tuple(np.concatenate(x) for x in zip(*found))

    def _widen(self) -> None:
        kept = self.features()
        while self.leaves > self.max_leaves:
            # a bound of 0 keeps equal points only; the first wider one is that of the nearest leaves seen
            self.radius = self.radius * WIDEN or float(np.sqrt(kept[2].max() / kept[0].min()) / (10 * self.max_leaves) + 1e-300)
            self.root, self.leaves = _Node(self.d, True), 0
            for i in range(len(kept[0])):
                self._one(float(kept[0][i]), kept[1][i], float(kept[2][i]))
                if self.leaves > self.max_leaves:
                    break


def _cells(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the points of each grid cell; two points of a cell are at most ``radius`` apart."""
    if radius > 0:
        cell = np.floor(points / (radius / np.sqrt(points.shape[1])))
    else:
        cell = points
    _, at = np.unique(cell, axis=0, return_inverse=True)
    at = at.ravel()
    k = int(at.max()) + 1
    s = np.stack([np.bincount(at, points[:, j], k) for j in range(points.shape[1])], axis=1)
    return np.bincount(at, minlength=k).astype(float), s, np.bincount(at, np.einsum("ij,ij->i", points, points), k)


def _rows(part: int, tree: Tree) -> pd.DataFrame:
    n, s, ss = tree.features() if tree.leaves else (np.zeros(0), np.zeros((0, tree.d)), np.zeros(0))
    return pd.DataFrame({"part": np.full(len(n), part, np.int32), "radius": tree.radius, "n": n.astype(np.int64),
                         "s": pd.Series(list(s), dtype=object), "ss": ss})


@dataclass(frozen=True)
class Leaves:
    """The summary: centres and counts of the leaves, squared distances inside each, and the bound in force."""

    centres: np.ndarray
    counts: np.ndarray
    inside: np.ndarray
    radius: float


def summarise(df: DataFrame, vector: Column, radius: float = 0.05, max_leaves: int = 5_000) -> Leaves:
    """CF-tree leaves of all rows.

    ``vector`` is an array of doubles of one length; rows where it is null or holds a null or a number that
    is not finite are left out. ``radius`` is a share of the points' root mean square distance
    from their mean, so it is the same at every scale of the features; 0 keeps every distinct point as a
    leaf. One aggregation finds mean and spread; one more pass builds the trees; at most ``max_leaves`` rows reach
    the driver.
    """
    x = df.select(vector.alias("x")).where("x IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))")
    m = (x.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("mean"), F.var_pop("col").alias("var"))
         .orderBy("pos").collect())
    if not m:
        return Leaves(np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0), 0.0)
    mean, bound = np.array([r["mean"] for r in m]), radius * float(np.sqrt(sum(r["var"] for r in m)))
    d = len(mean)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = Tree(d, bound, max_leaves), []

        def flush() -> None:
            if held:
                n, s, ss = (np.concatenate(v) for v in zip(*held))
                order = np.lexsort(s.T)  # whatever the order of the rows
                tree.insert(n[order], s[order], ss[order])
                held.clear()

        for batch in batches:
            column = batch.column(0)
            points = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - mean
            if len(points):
                held.append(_cells(points, tree.radius))
                if sum(len(h[0]) for h in held) > CELLS:
                    flush()
        flush()
        yield pa.RecordBatch.from_pandas(_rows(TaskContext.get().partitionId(), tree), schema=schema, preserve_index=False)

    schema = pa.schema([("part", pa.int32()), ("radius", pa.float64()), ("n", pa.int64()), ("s", pa.list_(pa.float64())),
                        ("ss", pa.float64())])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.stack(pdf["s"].to_numpy())
        order = np.lexsort(s.T)
        tree = Tree(d, float(pdf["radius"].max()), max_leaves)
        tree.insert(pdf["n"].to_numpy(float)[order], s[order], pdf["ss"].to_numpy()[order])
        return _rows(int(pdf["part"].iloc[0]), tree)

    found = reliable(x.mapInArrow(build, SCHEMA))
    parts = found.agg(F.max("part")).first()[0] or 0
    while parts:  # a merge takes the leaves of FAN_IN summaries, at most max_leaves each
        found = (found.withColumn("part", F.expr(f"cast(part div {FAN_IN} AS int)"))
                 .groupBy("part").applyInPandas(merge, SCHEMA))
        parts //= FAN_IN
    out = found.toPandas()
    n, s = out["n"].to_numpy(np.int64), np.stack(out["s"].to_numpy())
    order = np.lexsort(s.T)
    n, s, ss = n[order], s[order], out["ss"].to_numpy()[order]
    centres = s / n[:, None]
    inside = np.maximum(ss - n * np.einsum("ij,ij->i", centres, centres), 0)
    return Leaves(centres + mean, n, inside, float(out["radius"].max()))


def ward_chain(centres: np.ndarray, counts: np.ndarray, n_clusters: int) -> np.ndarray:
    """Ward's hierarchical clustering of weighted points, cut at ``n_clusters``; a label per point, by size.

    Nearest-neighbour chain: follow nearest neighbours until two are each other's, merge them, go on from
    the rest of the chain. Ward's criterion is reducible, so the merges are those of the greedy method; done in
    order of their cost they are cut at the wanted number. Memory is linear in the points.
    """
    k = len(centres)
    c, w, alive = centres.astype(float).copy(), counts.astype(float).copy(), np.ones(k, bool)
    merges, chain, first = [], [], 0
    for _ in range(k - 1):
        if not chain:
            first += int(np.argmax(alive[first:]))
            chain = [first]
        while True:
            a = chain[-1]
            away = c - c[a]
            cost = w * w[a] / (w + w[a]) * np.einsum("ij,ij->i", away, away)
            cost[~alive] = np.inf
            cost[a] = np.inf
            b = int(np.argmin(cost))
            if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((cost[b], a, b))
        c[a] = (w[a] * c[a] + w[b] * c[b]) / (w[a] + w[b])
        w[a] += w[b]
        alive[b] = False
    group = np.arange(k)

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[:max(0, k - n_clusters)]:
        group[root(b)] = root(a)
    roots = np.array([root(i) for i in range(k)])
    kept, at = np.unique(roots, return_inverse=True)
    size, first_of = np.bincount(at, counts), np.array([np.argmax(roots == r) for r in kept])
    label = np.empty(len(kept), np.int64)
    label[np.lexsort((first_of, -size))] = np.arange(len(kept))
    return label[at]


def nearest(vector: Column, leaves: Leaves, labels: np.ndarray) -> Column:
    """Label of the leaf whose centre is nearest; null where the vector has no place in the summary."""
    centres, of = leaves.centres, labels.astype(np.int64)

    @F.arrow_udf("int")
    def label(vectors: pa.Array) -> pa.Array:
        d, out = centres.shape[1], np.full(len(vectors), -1, np.int64)
        sizes = vectors.value_lengths().fill_null(0).to_numpy()
        flat, first = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        rows = np.flatnonzero(sizes == d) if d else np.zeros(0, np.int64)
        mid = centres.mean(axis=0) if len(centres) else 0.0
        c = centres - mid
        norm = np.einsum("ij,ij->i", c, c)
        step = max(1, 4_000_000 // max(1, len(c)))
        for a in range(0, len(rows), step):
            some = rows[a:a + step]
            points = flat[first[some, None] + np.arange(d)]
            fine = np.isfinite(points).all(axis=1)
            out[some[fine]] = of[np.argmin(norm - 2 * (points[fine] - mid) @ c.T, axis=1)]
        return pa.array(out.astype(np.int32), mask=out < 0)

    return label(vector)
