"""Nearest neighbours over every labelled row, without broadcasting them (JN8, ML8).

Points are projected on the few principal directions of a small sample. Quantiles of the labelled rows cut every
direction into ranges, and the cells of that grid are the bucket keys on which queries and labelled rows meet.
A projection never lengthens a distance, so a cell whose projected gap to a query is larger than a known bound on
the query's k-th distance holds none of its neighbours. Hence two rounds:

1. every query meets the labelled rows of its own cell; the k-th distance found, or that in a small sample of all
   labelled rows, is a bound;
2. it probes the other cells within that bound, nearest first and, with ``probes``, no more than so many.

Without ``probes`` the result is exact for any data. Directions with more spread get more ranges; where the sample says
that a bound would reach most cells (many dimensions of equal spread), there are fewer or only one, so queries are not
copied to cells in vain. Equal vectors are one point on both sides (of equal labelled rows those with the k
smallest ids are kept, no more can be neighbours), and a cell of many points meets in blocks of at most BLOCK by BLOCK,
so no key gathers in one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.operators.classify import _block_topk
from bizlens.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no installed package

#: Labelled points of a cell on average, of a block at most (also queries of a block), and of the sample.
CELL_ROWS, BLOCK, SAMPLE = 1_000, 16_384, 1_000
#: Ranges of a direction at most; directions; labelled points that cost about as much to compare as one more copy of a query.
MOST_RANGES, DIRECTIONS, COPY = 2_000, 3, 500
FOUND = "query_id long, neighbour_id long, distance2 double, neighbour_label double"
#: What a query finds in a block (``cell`` is -1), and the cells that it has yet to probe, its vector with each.
MET = f"{FOUND}, rank int, done boolean, cell long, vec binary, t_blocks int"
MET_NAMES = [c.split()[0] for c in MET.split(", ")]


def _directions(sample: np.ndarray, m: int) -> np.ndarray:
    """``m`` orthonormal directions, as columns: those of the largest spread of the sample first."""
    away = sample - sample.mean(axis=0)
    return np.linalg.eigh(away.T @ away)[1][:, ::-1][:, :min(m, sample.shape[1])]


def _ranges(spread: np.ndarray, cells: float) -> list[int]:
    """Ranges of every direction for about so many cells, in proportion to its spread."""
    out = [1] * len(spread)
    for m in range(int((spread > 0).sum()), 0, -1):
        per = (cells / np.prod(spread[:m])) ** (1 / m)
        if m == 1 or spread[m - 1] * per >= 1.5:
            out[:m] = [int(min(MOST_RANGES, max(1, round(s * per)))) for s in spread[:m]]
            break
    return out


def _grid(near: np.ndarray, axes: np.ndarray, n: int, k: int) -> list[int]:
    """Ranges of every direction with which ``n`` points like those of the sample cost a query least. It is
    a guess of the reach of a query, from how distances grow with rank in the sample, and decides on speed only."""
    at, size = (near - near.mean(axis=0)) @ axes, len(near)
    norm = np.einsum("ij,ij->i", near - near.mean(axis=0), near - near.mean(axis=0))
    gap = np.sort(np.maximum(norm[:, None] + norm - 2 * (near - near.mean(axis=0)) @ (near - near.mean(axis=0)).T, 0), axis=1)
    a, b = min(k, size - 1), min(4 * k, size - 1)
    kth, far = np.sqrt(np.median(gap[:, a])), np.sqrt(np.median(gap[:, b]))
    dim = np.log(b / a) / np.log(far / kth) if far > kth > 0 else 1.0
    reach = kth * min(1.0, size / n) ** (1 / max(dim, 1.0))
    # one cell, unless others cost clearly less
    best, choice, cells = 0.8 * (n + COPY * n / BLOCK), [1] * axes.shape[1], n / CELL_ROWS
    while cells > 1.5:
        ranges, probed = _ranges(at.std(axis=0), cells), np.ones(size)
        for j, r in enumerate(ranges):
            cuts = np.unique(np.quantile(at[:, j], np.arange(1, r) / r))
            probed *= np.searchsorted(cuts, at[:, j] + reach, "right") - np.searchsorted(cuts, at[:, j] - reach, "left") + 1
        if (cost := probed.mean() * (n / np.prod(ranges) + COPY)) < best:
            best, choice = cost, ranges
        cells /= 4
    return choice


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bytes(x: np.ndarray) -> pa.Array:
    """Every row as bytes."""
    each = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * each),
                                                       pa.py_buffer(np.ascontiguousarray(x))])


def _meet(train: DataFrame, queries: DataFrame, sizes: DataFrame, search) -> DataFrame:
    """What ``search`` finds for the queries of a ``cell`` among its labelled points, block by block."""
    wanted = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q_blocks"))
    # written, so that Spark knows how small it is
    blocks = materialise(wanted.join(sizes, "cell", "left").select("cell", "q_blocks", F.coalesce("t_blocks", F.lit(1)).alias("t_blocks")), "blocks")
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = (train.join(blocks, "cell").withColumn("t", salt("vec", "t_blocks"))
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).select("cell", "t", "q", "vec", "id", "label"))
    right = (queries.join(blocks, "cell").withColumn("q", salt("query_id", "q_blocks"))
             .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1))).select("cell", "t", "q", "query_id", "vec", "t_blocks"))
    return left.groupBy("cell", "t", "q").cogroup(right.groupBy("cell", "t", "q")).applyInPandas(search, MET)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance2", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def nearest_rows(train: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "features",
                 label_col: str = "label", probes: int | None = None, directions: int = DIRECTIONS, seed: int = 42) -> DataFrame:
    """``query_id``, ``neighbour_id``, ``distance2``, ``neighbour_label``, ``rank``: the k nearest labelled rows
    (squared Euclidean distance, ties by the smaller id) of every query row.

    Exact unless ``probes`` bounds the further cells that a query visits. Vectors are arrays of doubles of
    one length; rows with a null or not finite component, and labelled rows without an id, have no place
    in the search: such queries have no rows. Repeated query ids with one vector are answered once; fewer than
    k labelled rows are all returned. To the driver go the sample and the range boundaries, whose numbers
    are fixed (``SAMPLE``, ``MOST_RANGES``).
    """
    fine = F.col(f"`{vec_col}`").isNotNull() & F.forall(f"`{vec_col}`", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    vec = F.col(f"`{vec_col}`").cast("array<double>").alias("vec")
    key = F.col(f"`{id_col}`").cast("long")
    rows = train.where(fine & key.isNotNull()).select(key.alias("id"), vec, F.col(f"`{label_col}`").cast("double").alias("label"))
    like = F.xxhash64("vec").alias("like")  # compared first: sorting vectors is slow
    smallest = Window.partitionBy("like", "vec").orderBy("id")
    points = rows.select("id", "vec", "label", like).withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= k)
    points = materialise(points.select("id", "vec", "label"), "points")
    asked = materialise(queries.where(fine & key.isNotNull()).select(key.alias("id"), vec).distinct().select("id", "vec", like), "asked")
    distinct = asked.groupBy("like", "vec").agg(F.min("id").alias("query_id"))
    spark = train.sparkSession
    n = points.count()
    if not n:
        return spark.createDataFrame([], FOUND + ", rank int")
    near = np.stack(points.orderBy(F.xxhash64("vec", F.lit(seed)), "vec", "id").limit(SAMPLE).select("vec").toPandas()["vec"].to_numpy())
    origin, d = near.mean(axis=0), near.shape[1]
    axes = _directions(near, directions)
    ranges = _grid(near, axes, n, k) if len(near) > 1 else [1] * axes.shape[1]
    axes = axes[:, :max(1, sum(r > 1 for r in ranges))]  # those with one range come last

    @F.arrow_udf("array<double>")
    def project(v: pa.Array) -> pa.Array:
        x = (_matrix(v) - origin) @ axes if len(v) else np.zeros((0, axes.shape[1]))
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * axes.shape[1], x.ravel())

    edges = [np.zeros(0) for _ in range(axes.shape[1])]
    if max(ranges) > 1:
        wanted = [[i / r for i in range(1, r)] for r in ranges]
        found = points.select(project("vec").alias("at")).agg(*[F.percentile_approx(F.col("at")[i], w, 10 * len(w) + 10).alias(f"c{i}")
                                                                for i, w in enumerate(wanted) if w]).first()
        edges = [np.unique(found[f"c{i}"]) for i in range(axes.shape[1])]  # ranges between equal boundaries would be empty
    strides = np.concatenate(([1], np.cumprod([len(e) + 1 for e in edges])))[:-1].astype(np.int64)

    def cell_of(at: np.ndarray) -> np.ndarray:
        return sum(np.searchsorted(e, at[:, i], "right") * s for i, (e, s) in enumerate(zip(edges, strides)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, d))
            yield pa.RecordBatch.from_arrays([_bytes(x), pa.array(cell_of((x - origin) @ axes), pa.int64()), *batch.columns[1:]],
                                             ["vec", "cell", *batch.schema.names[1:]])

    points = materialise(points.select("vec", "id", "label").mapInArrow(place, "vec binary, cell long, id long, label double"), "placed")
    sizes = points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("t_blocks"))
    asked_at = materialise(distinct.select("vec", "query_id").mapInArrow(place, "vec binary, cell long, query_id long"), "asked_at")

    def further(x: np.ndarray, home: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the cells that are left to probe."""
        low = [np.concatenate(([-np.inf], e)) for e in edges]
        high = [np.concatenate((e, [np.inf])) for e in edges]
        reach = bound.copy()
        lost = np.flatnonzero(np.isinf(bound)) if len(near) >= k else []
        for a in range(0, len(lost), 512):  # the k-th labelled row of the sample
            some = x[lost[a:a + 512]]
            gap = np.zeros((len(some), len(near)))
            for j in range(d):
                gap += (some[:, j, None] - near[None, :, j]) ** 2
            reach[lost[a:a + 512]] = np.partition(gap, k - 1, axis=1)[:, k - 1]
        away = x - origin
        at = away @ axes
        reach += 1e-9 * (reach + np.einsum("ij,ij->i", away, away))  # rounding of projections
        far = np.sqrt(reach) * (1 + 1e-9)
        start = [np.searchsorted(e, at[:, j] - far, "left") for j, e in enumerate(edges)]
        wide = [np.searchsorted(e, at[:, j] + far, "right") - b + 1 for j, (e, b) in enumerate(zip(edges, start))]
        box = np.prod(wide, axis=0)  # cells around a query that may be near enough
        asking = np.flatnonzero(box > 1)
        upto = np.cumsum(box[asking])
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        a = 0
        while a < len(asking):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + 500_000)))
            some = asking[a:b]
            of = np.repeat(some, box[some])
            rest = np.arange(len(of)) - np.repeat(np.cumsum(box[some]) - box[some], box[some])
            gap, code = np.zeros(len(of)), np.zeros(len(of), np.int64)
            for j, stride in enumerate(strides):
                i = start[j][of] + rest % wide[j][of]
                rest //= wide[j][of]
                gap += np.maximum(0, np.maximum(low[j][i] - at[of, j], at[of, j] - high[j][i])) ** 2
                code += i * stride
            keep = np.flatnonzero((gap <= reach[of]) & (code != home))
            if probes is not None:
                keep = keep[np.lexsort((gap[keep], of[keep]))]
                keep = keep[np.arange(len(keep)) - np.searchsorted(of[keep], of[keep]) < probes]
            rows.append(of[keep])
            cells.append(code[keep])
            a = b
        return np.concatenate(rows), np.concatenate(cells)

    def search(a: pd.DataFrame, b: pd.DataFrame, last: bool) -> pd.DataFrame:
        """The nearest of the labelled rows ``a`` for the queries ``b`` and, unless this is the last round, the cells to probe."""
        if not len(b) or last and not len(a):
            return pd.DataFrame({c: [] for c in MET_NAMES})
        q, qid = np.frombuffer(b"".join(b["vec"]), float).reshape(len(b), d), b["query_id"].to_numpy(np.int64)
        kk, parts = min(k, len(a)), int(b["t_blocks"].iloc[0])
        cols, bound = [np.zeros(0)] * 4, np.full(len(b), np.inf)
        if len(a):
            labels = a["label"].to_numpy(float)  # a null label becomes NaN
            cols = [np.concatenate(c) for c in _block_topk(qid, q, a["id"].to_numpy(np.int64), np.frombuffer(b"".join(a["vec"]), float).reshape(-1, d), labels, k)]
            if kk == k:
                bound = cols[2].reshape(len(b), k)[:, -1]
        row, cell = (np.zeros(0, np.int64), np.zeros(0, np.int64)) if last else further(q, int(b["cell"].iloc[0]), bound)
        done = np.full(len(b), parts == 1 and not last)
        done[row] = False
        out = pd.DataFrame({"query_id": cols[0], "neighbour_id": cols[1], "distance2": cols[2], "neighbour_label": cols[3],
                            "rank": np.tile(np.arange(1, kk + 1), len(b)).astype(np.int32), "done": np.repeat(done, kk), "cell": -1,
                            "vec": None, "t_blocks": parts})
        if not len(row):
            return out
        more = pd.DataFrame({"query_id": qid[row], "neighbour_id": -1, "distance2": 0.0, "neighbour_label": 0.0, "rank": 0, "done": False,
                             "cell": cell, "vec": b["vec"].to_numpy()[row], "t_blocks": parts})
        return pd.concat([out, more]) if len(out) else more

    columns = ["query_id", "neighbour_id", "distance2", "neighbour_label", "rank"]
    if max(ranges) == 1:  # one cell: every query has met all labelled rows
        best = _first(_meet(points, asked_at, sizes, lambda a, b: search(a, b, True)).select(columns), k)
    else:
        first = materialise(_meet(points, asked_at, sizes, lambda a, b: search(a, b, False)), "met")
        probing = first.where("cell >= 0").select("query_id", "cell", "vec", "t_blocks")
        # the smallest bound of its blocks holds for a query: the cells that all of them name
        shared = (probing.where("t_blocks > 1").groupBy("query_id", "cell")
                  .agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.first("t_blocks").alias("t_blocks"))
                  .where("n = t_blocks").select("query_id", "cell", "vec"))
        probing = probing.where("t_blocks = 1").select("query_id", "cell", "vec").unionByName(shared)
        more = _meet(points, probing, sizes, lambda a, b: search(a, b, True))
        first = first.where("cell < 0")
        best = first.where("done").select(columns).unionByName(_first(first.where("NOT done").unionByName(more).select(columns), k))
    answered = asked.join(distinct, ["like", "vec"]).select("id", "query_id")
    return (answered.join(best, "query_id")
            .select(F.col("id").alias("query_id"), "neighbour_id", "distance2", "neighbour_label", "rank"))
