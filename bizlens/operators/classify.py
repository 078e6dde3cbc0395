"""Classification, nearest neighbours and scoring (ML8-ML13, ML15)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

try:  # ship this module's task-side functions by value: executors need not install bizlens
    from pyspark import cloudpickle as _cloudpickle
    import sys as _sys
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001  (older cloudpickle: fall back to import on executors)
    pass


# --------------------------------------------------------------------- KNN
#: Labelled rows that a batch of queries is compared with at a time.
TILE = 2_048


def _as_matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack(series.to_numpy()).astype(np.float64)


def _block_topk(qid: np.ndarray, Q: np.ndarray, ids: np.ndarray, X: np.ndarray, y: np.ndarray,
                k: int, batch: int = 256):
    """k nearest rows of X for every row of Q (squared Euclidean), exact.

    A float64 candidate pass on mean-centred data (translation keeps
    distances, centring shrinks the expanded-formula error) picks k + 8
    candidates; their distances are recomputed exactly from the raw values. A
    query whose k-th exact distance is not clearly below the best excluded
    candidate (error bound) is recomputed against every row. ``batch`` queries
    meet ``TILE`` rows at a time, so memory does not follow the rows of X.
    """
    n = len(ids)
    out_q, out_n, out_d, out_l = [], [], [], []
    if n == 0 or len(Q) == 0:
        return out_q, out_n, out_d, out_l
    mu = X.mean(axis=0)
    Xc = X - mu
    xn = np.einsum("ij,ij->i", Xc, Xc)
    xmax = float(xn.max())
    m = min(n, k + 8)
    kk = min(k, n)
    for s in range(0, len(Q), batch):
        q = Q[s:s + batch]
        qc = q - mu
        qn = np.einsum("ij,ij->i", qc, qc)
        if m < n:
            # the m candidates so far and the best excluded value, tile by tile
            part, pv = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
            for t in range(0, n, TILE):
                # |q|^2 is constant per row, so rank by |x|^2 - 2 q.x and add it back after
                approx = qc @ Xc[t:t + TILE].T
                approx *= -2.0
                approx += xn[t:t + TILE]
                hits = approx < pv[:, -1:] if pv.shape[1] > m else np.ones((1, m + 1), bool)
                if (most := int(hits.sum(axis=1).max())) <= min(m, approx.shape[1]):
                    # few are better than what a query has: only those, side by side
                    r, c = np.nonzero(hits)
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    best, near = np.zeros((len(q), most), np.int64), np.full((len(q), most), np.inf)
                    best[r, place], near[r, place] = c, approx[r, c]
                    approx = near
                elif approx.shape[1] > m + 1:
                    best = np.argpartition(approx, m, axis=1)[:, :m + 1]
                    approx = np.take_along_axis(approx, best, axis=1)
                else:
                    best = np.tile(np.arange(approx.shape[1]), (len(q), 1))
                part, pv = np.concatenate([part, best + t], axis=1), np.concatenate([pv, approx], axis=1)
                order = np.argsort(pv, axis=1, kind="stable")[:, :m + 1]
                part, pv = np.take_along_axis(part, order, axis=1), np.take_along_axis(pv, order, axis=1)
            cand = part[:, :m]
            excluded_min = pv[:, m] + qn
        else:
            cand = np.tile(np.arange(n), (len(q), 1))
        exact = ((q[:, None, :] - X[cand]) ** 2).sum(axis=2)
        if m < n:
            tol = 1e-12 * (qn + xmax)
            kth = np.sort(exact, axis=1)[:, kk - 1]
            redo_rows = set(np.where(kth + tol >= excluded_min - tol)[0].tolist())
        else:
            redo_rows = set()
        # sort all rows of the block at once: by query, distance, neighbour id
        rows = np.repeat(np.arange(len(q)), m)
        order = np.lexsort((ids[cand].ravel(), exact.ravel(), rows)).reshape(len(q), m)[:, :kk]
        nn, dd = cand.ravel()[order], exact.ravel()[order]
        for r in redo_rows:  # rounding could have hidden a neighbour: full distances
            d_all = ((X - q[r]) ** 2).sum(axis=1)
            nn[r] = np.lexsort((ids, d_all))[:kk]
            dd[r] = d_all[nn[r]]
        out_q.append(np.repeat(qid[s:s + batch], kk))
        out_n.append(ids[nn].ravel())
        out_d.append(dd.ravel())
        out_l.append(y[nn].ravel())
    return out_q, out_n, out_d, out_l


_CAND_SCHEMA = StructType([StructField("query_id", LongType()), StructField("neighbour_id", LongType()),
                           StructField("distance2", DoubleType()), StructField("neighbour_label", DoubleType())])


def knn_neighbours(train: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id",
                   vec_col: str = "features", label_col: str = "label", fit_rows: int | None = None) -> DataFrame:
    """Exact k nearest of the fitted rows for every query row (squared Euclidean).

    Every labelled row is searched, through buckets and without a broadcast
    (``neighbours.nearest_rows``). Ties are broken by (distance, neighbour id).
    A caller may fit on no more than ``fit_rows`` labelled rows, those with the
    smallest hash of the key. These are broadcast and every query is searched
    where it is, without a shuffle.
    """
    if fit_rows is None:
        from bizlens.operators.neighbours import nearest_rows  # builds on the block search above
        return nearest_rows(train, queries, k, id_col, vec_col, label_col)
    fitted = (train.select(F.col(id_col).cast("long").alias("_tid"), F.col(vec_col).alias("_vec"),
                           F.col(label_col).cast("double").alias("_label"))
              .orderBy(F.xxhash64("_tid"), "_tid").limit(fit_rows).toPandas())
    shared = train.sparkSession.sparkContext.broadcast(
        (fitted["_tid"].to_numpy(np.int64), _as_matrix(fitted["_vec"]) if len(fitted) else np.zeros((0, 0)),
         fitted["_label"].to_numpy(np.float64)))

    def search(batches):
        ids, matrix, labels = shared.value
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            found = _block_topk(pdf["_qid"].to_numpy(np.int64), _as_matrix(pdf["_vec"]), ids, matrix, labels, k)
            cols = [np.concatenate(c) for c in found]
            per = min(k, len(ids))
            yield pd.DataFrame({"query_id": cols[0], "neighbour_id": cols[1], "distance2": cols[2],
                                "neighbour_label": cols[3],
                                "rank": np.tile(np.arange(1, per + 1), len(pdf)).astype(np.int32)})

    schema = StructType([*_CAND_SCHEMA.fields, StructField("rank", IntegerType())])
    return (queries.select(F.col(id_col).cast("long").alias("_qid"), F.col(vec_col).alias("_vec"))
            .mapInPandas(search, schema))


def knn_vote(neighbours: DataFrame, out_col: str = "prediction") -> DataFrame:
    """Majority label among the neighbours; ties go to the smallest label."""
    votes = neighbours.groupBy("query_id", "neighbour_label").agg(F.count(F.lit(1)).alias("_v"))
    w = Window.partitionBy("query_id").orderBy(F.col("_v").desc(), F.col("neighbour_label").asc())
    return (votes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
                 .select("query_id", F.col("neighbour_label").alias(out_col)))


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5, id_col: str = "id",
                vec_col: str = "features", label_col: str = "label", fit_rows: int | None = None) -> DataFrame:
    """ML8: KNN classifier; returns ``test`` rows with a ``prediction`` column.
    The nearest of every labelled row vote, or of ``fit_rows`` of them."""
    nb = knn_neighbours(train, test, k, id_col, vec_col, label_col, fit_rows)
    pred = knn_vote(nb).withColumnRenamed("query_id", id_col)
    return test.join(pred, id_col)


# ------------------------------------------------------------ model fits
def fit_logistic(train: DataFrame, features_col: str = "features", label_col: str = "label",
                 C: float = 1.0, n_rows: int | None = None, max_iter: int = 100, tol: float = 1e-4):
    """ML9: L2 logistic regression with inverse strength ``C`` (regParam = 1 / (C n)),
    at most 100 L-BFGS iterations with tolerance 1e-4 (the usual library defaults).
    Each iteration is one distributed gradient aggregation."""
    n = n_rows if n_rows is not None else train.count()
    return LogisticRegression(featuresCol=features_col, labelCol=label_col, regParam=1.0 / (C * max(n, 1)),
                              elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol).fit(train)


def fit_naive_bayes(train: DataFrame, features_col: str = "features", label_col: str = "label"):
    """ML10: Gaussian naive Bayes."""
    return NaiveBayes(featuresCol=features_col, labelCol=label_col, modelType="gaussian").fit(train)


def fit_forest(train: DataFrame, features_col: str = "features", label_col: str = "label",
               trees: int = 100, max_depth: int = 30, seed: int = 42):
    """ML11: random forest, ``sqrt`` features per split, bootstrap per tree.

    Every tree is grown from all rows, by Gini impurity on at most 32 bins a feature and until nodes are pure,
    gain nothing or are ``max_depth`` deep (see ``forest``).
    """
    from bizlens.operators import forest
    return forest.fit(train, features_col, label_col, trees, max_depth, seed)


# ------------------------------------------------------------ scoring
def confusion(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """ML15: counts per (label, prediction)."""
    return pred.groupBy(label_col, pred_col).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                   positive=1, model: str | None = None) -> DataFrame:
    """ML12: accuracy, F1, precision, recall for the positive class, one row.

    One aggregation of the confusion counts; an undefined ratio (no positive
    predictions / labels) is 0, as the common metric libraries report it.
    """
    y = F.col(label_col) == F.lit(positive)
    p = F.col(pred_col) == F.lit(positive)
    c = pred.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                 F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    d = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = c.select(
        d(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        d(2 * tp, 2 * tp + fp + fn).alias("f1"),
        d(tp, tp + fp).alias("precision"),
        d(tp, tp + fn).alias("recall"))
    if model is not None:
        out = out.select(F.lit(model).alias("model"), "*")
    return out


def leaderboard(results: list[DataFrame], by: str = "accuracy") -> DataFrame:
    """ML13: stack one-row results and sort best first."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.orderBy(F.col(by).desc(), F.col("model"))
