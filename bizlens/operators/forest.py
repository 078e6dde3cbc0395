"""Random forest on binned features: every tree on all rows, grown by rows that move to its nodes (ML11).

Features are cut at quantiles of all rows into at most BINS bins. Rows with the same bins and label are one row with a
count, and are kept as blocks of bin numbers. A row counts in a tree as often as a Poisson draw with its count as the mean
says (the bootstrap). While a node weighs more than LOCAL rows, its histograms are summed over all blocks, one job a level for all
trees. The rows of a smaller node are grouped by tree and node, and a task grows what is below it level by
level. No task holds more than a node's LOCAL rows, and only the few nodes above them reach the driver; what is below stays a
table. Rows to be predicted meet it in blocks, and each block sums the shares that its rows find in the trees.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no installed package

#: Bins of a feature; rows of a node that one task may hold, and their bytes of bins; nodes whose histograms a job sums;
#: nodes split at a time; rows of a block to fit on, and of one to predict.
BINS, LOCAL, HELD, OPEN, SLOTS, ROWS, ASKED = 32, 131_072, 32 << 20, 4_096, 4_096, 65_536, 16_384
SUBTREES = "g long, feature array<short>, cut array<short>, below array<int>, p array<float>"
#: Poisson(1) of every 16-bit number.
DRAWS = np.searchsorted(np.floor(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)]) * 65_536), np.arange(65_536), "right").astype(np.uint8)


def _drawn(rng: np.random.Generator, n: np.ndarray) -> np.ndarray:
    """How often rows that stand for ``n`` rows count in a tree."""
    w = DRAWS[rng.integers(0, 65_536, len(n), np.uint16)].astype(np.int32)
    many = np.flatnonzero(n > 1)
    w[many] = rng.poisson(n[many])
    return w


def _binned(vectors: pa.Array, edges: list[np.ndarray]) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), len(edges))
    out = np.empty(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = ~(x[:, i] <= e[0]) if len(e) == 1 else np.searchsorted(e, x[:, i], "left")
    return out


def _bytes(x: np.ndarray) -> pa.Array:
    """Every row as bytes."""
    at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))])


def _rows(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """The bytes of all rows of a column, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _squeeze(x: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bins in fewer bytes: features of two bins as bits."""
    return np.concatenate([x[:, widths > 2], np.packbits(x[:, widths <= 2], axis=1)], axis=1)


def _spread(packed: np.ndarray, widths: np.ndarray) -> np.ndarray:
    out, many = np.empty((len(packed), len(widths)), np.uint8), int((widths > 2).sum())
    out[:, widths > 2] = packed[:, :many]
    out[:, widths <= 2] = np.unpackbits(packed[:, many:], axis=1, count=len(widths) - many)
    return out


def _first_bins(chosen: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, int]:
    """The place of the first bin of every chosen feature of every node when all their bins stand in a row, and the number of bins."""
    each = widths[chosen]
    ends = np.cumsum(each)
    return ends.reshape(each.shape) - each, int(ends[-1])


def _histograms(at: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, chosen: np.ndarray, first: np.ndarray, bins: int,
                classes: int) -> np.ndarray:
    """Weighted rows by (class, bin of a chosen feature of a node); ``at`` is each row's node."""
    m, flat, base, own = chosen.shape[1], x.ravel(), np.arange(len(at)) * x.shape[1], y * bins
    keys = np.empty((m, len(at)), np.int64)
    for j in range(m):
        keys[j] = flat[base + chosen[:, j][at]]
        keys[j] += first[:, j][at]
        keys[j] += own
    return np.bincount(keys.ravel(), np.tile(w, m), bins * classes).reshape(classes, bins)


def _best(hist: np.ndarray, chosen: np.ndarray, first: np.ndarray, widths: np.ndarray):
    """(number of the chosen feature, last bin to the left, does it gain, left and right rows by class) per node, by Gini impurity."""
    n, m = chosen.shape
    each = widths[chosen].ravel()
    starts, part = first.ravel(), np.repeat(np.arange(n * m), each)
    node = np.repeat(np.arange(n), each.reshape(n, m).sum(axis=1))
    left, square, size = [], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]  # to the left, to the right, in the node
    total = []
    for h in hist:
        upto = np.cumsum(h)
        here = upto - (upto[starts] - h[starts])[part]
        every = here[first[:, 0] + widths[chosen[:, 0]] - 1]
        for i, c in enumerate((here, every[node] - here, every)):
            square[i] = square[i] + c * c
            size[i] = size[i] + c
        left.append(here)
        total.append(every)
    gain = square[0] / np.maximum(size[0], 1e-12) + square[1] / np.maximum(size[1], 1e-12) - (square[2] / np.maximum(size[2], 1e-12))[node]
    gain[(size[0] == 0) | (size[1] == 0)] = -1
    most = np.maximum.reduceat(gain, first[:, 0])
    at = np.flatnonzero(gain == most[node])
    at = at[np.searchsorted(node[at], np.arange(n))]
    lefts = np.stack([c[at] for c in left], axis=1)
    return part[at] % m, at - starts[part[at]], most > 1e-9 * size[2], lefts, np.stack(total, axis=1) - lefts


def _subset(rng: np.random.Generator, nodes: int, features: int, m: int) -> np.ndarray:
    """``m`` different features for every node, all sets alike (Floyd's draws), in an order drawn for all of them."""
    out = np.empty((nodes, m), np.int64)
    for i, top in enumerate(range(features - m, features)):
        drawn = rng.integers(0, top + 1, nodes)
        out[:, i] = np.where((out[:, :i] == drawn[:, None]).any(axis=1), top, drawn)
    return out[:, rng.permutation(m)]


def _route(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The node that each row ends in."""
    at, flat, d = np.zeros(len(x), np.int64), x.ravel(), x.shape[1]
    rows = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(rows):
        node = at[rows]
        node = below[node] + (flat[rows * d + feature[node]] > cut[node])
        at[rows] = node
        rows = rows[feature[node] >= 0]
    return at


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, m: int, levels: int, rng: np.random.Generator):
    """(feature, cut, below, p) of the nodes of a subtree; the right child follows the left one, -1 marks a leaf."""
    widths, d = x.max(axis=0).astype(np.int64) + 1, x.shape[1]
    mixed = lambda counts, left: ((counts > 0).sum(axis=1) > 1) & (left > 0)
    # ids are the places of the nodes in their level; the rows of the mixed ones stand node by node, size of each
    out, base, ids, counts = [], 0, np.zeros(1, np.int64), np.bincount(y, w, classes)[None]
    live = mixed(counts, levels)
    size = np.array([len(y)])[live]
    while len(ids):
        n = len(ids)
        feature, cut, below, p = np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n, np.int32), np.empty((n, classes))
        p[ids] = counts / counts.sum(axis=1, keepdims=True)
        ids, found, ends = ids[live], [], np.cumsum(size)
        for a in range(0, len(ids), SLOTS):
            own = size[a:a + SLOTS]
            some = slice(ends[a] - own[0], ends[a + len(own) - 1])
            chosen = _subset(rng, len(own), d, m)
            first, bins = _first_bins(chosen, widths)
            hist = _histograms(np.repeat(np.arange(len(own)), own), x[some], y[some], w[some], chosen, first, bins, classes)
            j, b, gains, left, right = _best(hist, chosen, first, widths)
            found.append((chosen[np.arange(len(own)), j], b, gains, left, right))
        if found:
            f, b, gains, left, right = (np.concatenate(c) for c in zip(*found))
            k = int(gains.sum())
            feature[ids[gains]], cut[ids[gains]] = f[gains], b[gains]
            below[ids[gains]] = base + n + 2 * np.arange(k)
            node = np.repeat(np.arange(len(f)), size)
            side = x.ravel()[np.arange(len(x)) * d + f[node]] > b[node]
            go = [gains & mixed(left, levels - 1), gains & mixed(right, levels - 1)]
            # the rows of all left children, then those of all right ones
            order = np.concatenate([np.flatnonzero(~side & go[0][node]), np.flatnonzero(side & go[1][node])])
            at = np.concatenate([2 * node[~side], 2 * node[side] + 1])
            size = np.bincount(at, minlength=2 * len(f)).reshape(-1, 2).T
            size = np.concatenate([size[0][go[0]], size[1][go[1]]])
            x, y, w = x.take(order, axis=0), y[order], w[order]
            counts, live = np.concatenate([left[gains], right[gains]]), np.concatenate([go[0][gains], go[1][gains]])
            ids = np.concatenate([2 * np.arange(k), 2 * np.arange(k) + 1])
        out.append((feature, cut, below, p))
        base, levels = base + n, levels - 1
    return [np.concatenate(c) for c in zip(*out)]


def _boxed(df: DataFrame, rows: int) -> DataFrame:
    """The rows of every task in blocks: their bins, first column, as bytes one after the other, and their other columns alike."""
    names = df.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, k = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            while sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held)
                held = table.slice(rows).to_batches()
                yield block(table.slice(0, rows), (part << 32) + k)
                k += 1
        if held:
            yield block(pa.Table.from_batches(held), (part << 32) + k)

    def block(table: pa.Table, number: int) -> pa.RecordBatch:
        cols = [b"".join(table.column(0).to_pylist()), *(table.column(i).to_numpy().tobytes() for i in range(1, len(names)))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], ["block", *names])

    return df.mapInArrow(pack, ", ".join(["block long", *(f"`{c}` binary" for c in names)]))


class Forest:
    """A fitted forest: the upper nodes of each tree, and a table of subtrees below them."""

    def __init__(self, features_col: str, edges: list, tops: list, owners: list, subtrees: DataFrame, classes: int) -> None:
        self.features_col, self.edges, self.tops, self.owners = features_col, edges, tops, owners
        self.subtrees, self.classes = subtrees, classes

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``: the class with the largest sum of the trees' shares, the smaller one of equals."""
        edges, classes, d = self.edges, self.classes, len(self.edges)
        widths = np.array([len(e) + 1 for e in edges])

        @F.arrow_udf("binary")
        def bins(vectors: pa.Array) -> pa.Array:
            return _bytes(_binned(vectors, edges)) if len(vectors) else pa.array([], pa.binary())

        df = materialise(df.withColumn("_bins", bins(vector_to_array(self.features_col))), "to_predict")
        # rows of the same bins are asked for once
        asked = materialise(_boxed(df.select("_bins").distinct(), ASKED), "asked")
        shared = df.sparkSession.sparkContext.broadcast((self.tops, self.owners))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops, owners = shared.value
            for batch in batches:
                for block, xs in zip(*(batch.column(i).to_pylist() for i in range(2))):
                    x = np.frombuffer(xs, np.uint8).reshape(-1, d)
                    packed = _squeeze(x, widths)
                    for top, own in zip(tops, owners):
                        g = own[_route(x, *top)]
                        order = np.argsort(g, kind="stable")
                        found, start = np.unique(g[order], return_index=True)
                        parts = np.split(order.astype(np.int32), start[1:])
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.full(len(found), block)), pa.array([r.tobytes() for r in parts]),
                                                          pa.array([packed[r].tobytes() for r in parts])], ["g", "block", "at", "x"])

        def share(trees: pa.Table, rows: pa.Table) -> pa.Table:
            blocks, at, shares = [], [], []
            if trees.num_rows and rows.num_rows:
                f, c, b, p = (trees.column(n).combine_chunks().flatten().to_numpy() for n in ("feature", "cut", "below", "p"))
                blocks, at = rows.column("block").to_pylist(), rows.column("at").to_pylist()
                x = _spread(_rows(rows.column("x"), np.uint8).reshape(sum(map(len, at)) // 4, -1), widths)
                found = p.reshape(-1, classes)[_route(x, f, c, b)]
                ends = np.cumsum([len(r) // 4 for r in at])
                shares = [v.tobytes() for v in np.split(found, ends[:-1])]
            return pa.table({"block": pa.array(blocks, pa.int64()), "at": pa.array(at, pa.binary()), "p": pa.array(shares, pa.binary())})

        def decide(asked: pa.Table, votes: pa.Table) -> pa.Table:
            xs, found = [], []
            if asked.num_rows:
                x = np.frombuffer(asked.column("_bins")[0].as_py(), np.uint8).reshape(-1, d)
                total = np.zeros((len(x), classes))
                for at, p in zip(votes.column("at").to_pylist(), votes.column("p").to_pylist()):
                    total[np.frombuffer(at, np.int32)] += np.frombuffer(p, np.float32).reshape(-1, classes)
                xs, found = _bytes(x), np.round(total, 6).argmax(axis=1).astype(float)
            return pa.table({"_bins": pa.array(xs, pa.binary()), "prediction": pa.array(found, pa.float64())})

        placed = asked.mapInArrow(place, "g long, block long, at binary, x binary")
        votes = (self.subtrees.groupBy("g").cogroup(placed.groupBy("g")).applyInArrow(share, "block long, at binary, p binary"))
        best = asked.groupBy("block").cogroup(votes.groupBy("block")).applyInArrow(decide, "_bins binary, prediction double")
        return df.join(materialise(best, "predicted"), "_bins").drop("_bins")


def fit(train: DataFrame, features_col: str, label_col: str, trees: int, max_depth: int, seed: int) -> Forest:
    """A forest of ``trees``, the root of the number of features tried at every node; labels are 0, 1 and so on."""
    spark = train.sparkSession
    x = vector_to_array(features_col)
    rows = train.select(x.alias("x"), F.col(label_col).cast("double").alias("y"))
    top_label, d, n, unlabelled = rows.agg(F.max("y"), F.max(F.size("x")), F.count(F.lit(1)), F.count_if(F.col("y").isNull())).first()
    if not n or unlabelled:
        raise ValueError("a forest needs rows, and a label in each")
    classes, m = max(2, int(top_label) + 1), math.ceil(math.sqrt(d))
    local = min(LOCAL, max(1, HELD // d))
    wanted = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.col("x")[i], wanted, 100 * BINS).alias(f"e{i}") for i in range(d)]).first()
    edges = [np.unique(np.array(found[i], float)) for i in range(d)]
    widths = np.array([len(e) + 1 for e in edges])

    @F.arrow_udf("binary")
    def bins(vectors: pa.Array) -> pa.Array:
        return _bytes(_binned(vectors, edges)) if len(vectors) else pa.array([], pa.binary())

    alike = rows.select(bins("x").alias("x"), F.col("y").cast("short").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    parts = max(2 * spark.sparkContext.defaultParallelism, n // ROWS)
    blocks = materialise(_boxed(alike.repartition(parts), ROWS), "blocks")

    def counted(batches: Iterator[pa.RecordBatch], tops: list, of: list) -> Iterator[tuple]:
        """(tree, nodes, bins, classes and weights of the rows that count in it, the block's bins, places of the rows) for the trees ``of``."""
        for batch in batches:
            for block, xs, ys, ns in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y, n = np.frombuffer(xs, np.uint8).reshape(-1, d), np.frombuffer(ys, np.int16).astype(np.int64), np.frombuffer(ns, np.int64)
                packed = _squeeze(x, widths)
                for t in of:
                    w = _drawn(np.random.default_rng([seed, t, block]), n)
                    kept = np.flatnonzero(w)
                    own = x[kept]
                    yield t, _route(own, *tops[t]), own, y[kept], w[kept], packed, kept

    grown = [([-1], [0], [0]) for _ in range(trees)]  # feature, cut, below of the upper nodes
    leaves: dict[tuple[int, int], np.ndarray] = {}  # upper nodes without a split
    small = [(t, 0, 0) for t in range(trees)] if n <= local else []
    todo = [(t, 0, 0) for t in range(trees)] if n > local else []
    arrays = lambda: [(np.array(f, np.int16), np.array(c, np.int16), np.array(b, np.int32)) for f, c, b in grown]
    while todo:
        now, todo = sorted(todo)[:OPEN], sorted(todo)[OPEN:]
        chosen = np.concatenate([_subset(np.random.default_rng([seed, t, node, 1]), 1, d, m) for t, node, _ in now])
        slots = [np.full(len(f), -1) for f, _, _ in grown]
        for s, (t, node, _) in enumerate(now):
            slots[t][node] = s
        shared = spark.sparkContext.broadcast((arrays(), slots, chosen))

        def sums(batches, shared=shared):
            tops, slots, chosen = shared.value
            first, bins = _first_bins(chosen, widths)
            ends = np.append(first[1:, 0], bins)
            total = np.zeros((classes, bins))
            opened = {t: np.flatnonzero(s >= 0) for t, s in enumerate(slots) if (s >= 0).any()}
            for t, node, x, y, w, _, _ in counted(batches, tops, list(opened)):
                a, b = slots[t][opened[t]].min(), slots[t][opened[t]].max() + 1  # the slots of a tree stand side by side
                s = slots[t][node]
                here = np.flatnonzero(s >= 0)
                if len(here) < len(s):
                    x, y, w, s = x[here], y[here], w[here], s[here]
                some = slice(first[a, 0], ends[b - 1])
                total[:, some] += _histograms(s - a, x, y, w, chosen[a:b], first[a:b] - first[a, 0], int(ends[b - 1] - first[a, 0]), classes)
            some = [s for s in range(len(chosen)) if total[:, first[s, 0]:ends[s]].any()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([s % 64 for s in some], pa.int64()),
                                              pa.array([total[:, first[s, 0]:ends[s]].tobytes() for s in some], pa.binary())], ["s", "part", "h"])

        def choose(table: pa.Table) -> pa.Table:
            total = {}
            for s, h in zip(table.column("s").to_pylist(), table.column("h").to_pylist()):
                h = np.frombuffer(h).reshape(classes, -1)
                total[s] = total[s] + h if s in total else h
            own = sorted(total)
            some = chosen[own]
            j, b, gains, left, right = _best(np.concatenate([total[s] for s in own], axis=1), some, _first_bins(some, widths)[0], widths)
            return pa.table({"s": own, "j": j, "b": b, "gains": gains, "l": pa.array(left.tolist()), "r": pa.array(right.tolist())})

        best = (blocks.mapInArrow(sums, "s long, part long, h binary").groupBy("part")
                .applyInArrow(choose, "s long, j long, b long, gains boolean, l array<double>, r array<double>").collect())
        for r in sorted(best):
            t, node, depth = now[r.s]
            feature, cut, below = grown[t]
            if not r.gains or depth >= max_depth:
                leaves[t, node] = np.add(r.l, r.r)
                continue
            feature[node], cut[node], below[node] = int(chosen[r.s, r.j]), r.b, len(feature)
            for side in (r.l, r.r):
                child = (t, len(feature), depth + 1)
                (todo if sum(side) > local and depth + 1 < max_depth else small).append(child)
                for part, v in zip(grown[t], (-1, 0, 0)):
                    part.append(v)

    tops = arrays()
    owners = [np.full(len(f), -1, np.int64) for f, _, _ in tops]
    for g, (t, node, *_) in enumerate([*small, *leaves]):
        owners[t][node] = g
    shared = spark.sparkContext.broadcast((tops, owners, [depth for _, _, depth in small]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, owners, depths = shared.value
        for t, node, _, y, w, packed, kept in counted(batches, tops, list(range(trees))):
            g = owners[t][node]
            order = np.argsort(g, kind="stable")
            found, start = np.unique(g[order], return_index=True)
            ends = np.append(start[1:], len(g))
            cols = [c.tobytes() for c in (packed[kept[order]], y[order].astype(np.int16), w[order])]
            of = [(v, a, b) for v, a, b in zip(found.tolist(), start.tolist(), ends.tolist()) if v < len(depths)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _, _ in of], pa.int64()), *(
                pa.array([c[a * z:b * z] for _, a, b in of], pa.binary()) for c, z in zip(cols, (packed.shape[1], 2, 4)))], ["g", "x", "y", "w"])

    def grow(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        y, w = _rows(table.column("y"), np.int16), _rows(table.column("w"), np.int32)
        x = _spread(_rows(table.column("x"), np.uint8).reshape(len(y), -1), widths)
        found = _grow(x, y.astype(np.int64), w.astype(float), classes, m, max_depth - shared.value[2][g], np.random.default_rng([seed, g, 2]))
        return pa.table({"g": [g], **{c: [v.ravel()] for c, v in zip(("feature", "cut", "below", "p"), found)}}).cast(pa.schema(
            [("g", pa.int64()), ("feature", pa.list_(pa.int16())), ("cut", pa.list_(pa.int16())), ("below", pa.list_(pa.int32())),
             ("p", pa.list_(pa.float32()))]))

    subtrees = blocks.mapInArrow(deal, "g long, x binary, y binary, w binary").groupBy("g").applyInArrow(grow, SUBTREES)
    ends = [(len(small) + i, [-1], [0], [0], [float(v) for v in c / c.sum()]) for i, c in enumerate(leaves.values())]
    subtrees = materialise(subtrees.unionByName(spark.createDataFrame(ends, SUBTREES)), "subtrees")
    return Forest(features_col, edges, tops, owners, subtrees, classes)
