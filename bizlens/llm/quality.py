"""Quality classifier by co-training of two views.

The content view reads byte trigrams of the text. The page-metadata view reads source,
language and layout figures (length, lines, shares of capitals, digits and marks, share of
distinct words). Each is a logistic regression. In every round each classifier hands its
most confident labels of unlabelled documents to the other one, which is then fitted anew.
Both are calibrated on labelled rows kept apart, and their calibrated log-odds are combined.

Fitting uses a bounded sample (``LABELLED`` labelled and ``UNLABELLED`` other rows, chosen by
a hash of the id); every document is scored from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

LABELLED, UNLABELLED = 3000, 3000
#: Buckets of byte trigrams, of sources and of languages.
TRIGRAMS, SOURCES, LANGS = 2048, 32, 16
ROUNDS = 4
#: Pseudo-labels that one view hands to the other in a round.
HANDED = 200
#: A document is rejected when its probability of good quality is below this.
THRESHOLD = 0.4

_FIGURES = 9


class Model(NamedTuple):
    """Weights (last one: constant) of both views, scaling of the metadata, calibration and mixing."""

    content: np.ndarray
    metadata: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    calibration: np.ndarray  # slope and constant of both views
    mixing: np.ndarray  # weights of both views and constant


def _kinds() -> np.ndarray:
    """Byte classes for the layout figures, one column each: capital, digit, mark, space, line end, high byte."""
    b = np.arange(256)
    upper, digit = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    space, line, high = (b == 32) | (b == 9), b == 10, b >= 128
    lower = (b >= 97) & (b <= 122)
    mark = ~(upper | lower | digit | space | line | high)
    return np.stack([upper, digit, mark, space, line, high], 1)


_KINDS = _kinds()


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that begins at each byte but the last two."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    t = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
    return ((t * np.uint32(2654435761)) >> np.uint32(32 - 11)).astype(np.int64) % TRIGRAMS


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def metadata(data: np.ndarray, offsets: np.ndarray, langs: list, sources: list) -> np.ndarray:
    """Row per text: layout figures, then one-hot buckets of language and source."""
    n = np.diff(offsets)
    out = np.zeros((len(n), _FIGURES + LANGS + SOURCES))
    size = np.maximum(n, 1)
    for k in range(_KINDS.shape[1]):
        out[:, k] = _per_text(_KINDS[data, k], offsets) / size
    out[:, 6] = np.log1p(n)
    hashes, counts = T.words(data, offsets)
    words = np.diff(counts)
    owner = np.repeat(np.arange(len(words)), words)
    _, first = np.unique(T.mix64(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(owner[first], minlength=len(words))
    # texts grow faster than vocabularies: distinct words against a power of all words
    out[:, 7] = np.log1p(distinct) - 0.9 * np.log1p(words)
    out[:, 8] = n / np.maximum(words, 1) / 10
    for i, (lang, source) in enumerate(zip(langs, sources)):
        if lang is not None:
            out[i, _FIGURES + crc32(str(lang).encode()) % LANGS] = 1
        if source is not None:
            out[i, _FIGURES + LANGS + crc32(str(source).encode()) % SOURCES] = 1
    return out


def _content_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row per text: square roots of trigram shares."""
    buckets = trigram_buckets(data)
    out = np.zeros((len(offsets) - 1, TRIGRAMS), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        c = np.bincount(buckets[a:max(a, b - 2)], minlength=TRIGRAMS)
        out[i] = np.sqrt(c / max(1, c.sum()))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weighted logistic regression by Adam; the last weight is the constant."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        # products in the type of x: no wider copy of the whole matrix in every step
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -30, 30)))
        d = (p - y) * weight / weight.sum()
        g = np.append(d.astype(x.dtype) @ x + l2 * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x @ w[:-1].astype(x.dtype)).astype(float) + w[-1]


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, apart: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``y``: 0 or 1, -1 where unlabelled; ``apart``: labelled rows kept for calibration."""
    centre, spread = meta.mean(0), meta.std(0) + 1e-6
    meta = (meta - centre) / spread
    views = (content, meta)
    known = (y >= 0) & ~apart
    share = float(np.clip(y[known].mean(), 0.02, 0.98))
    labels = [np.where(known, y, -1) for _ in views]
    weights: list = [None, None]
    for turn in range(rounds + 1):
        for k, x in enumerate(views):
            use = labels[k] >= 0
            part = np.where(labels[k][use] == 1, 0.5 / share, 0.5 / (1 - share))  # both classes count alike
            weights[k] = _logistic(x[use], labels[k][use], part)
        if turn == rounds:
            break
        for k, x in enumerate(views):
            other = labels[1 - k]
            odds = np.where(other < 0, _odds(x, weights[k]), np.nan)
            odds[apart] = np.nan
            order = np.argsort(odds, kind="stable")[:int(np.isfinite(odds).sum())]
            good, bad = max(1, int(HANDED * share)), max(1, int(HANDED * (1 - share)))
            up, down = order[::-1][:good], order[:bad]
            other[up[odds[up] > 1]] = 1
            other[down[odds[down] < -1]] = 0
    rows = apart if len(set(y[apart])) == 2 else known
    even = np.ones(int(rows.sum()))
    pairs = [_logistic(_odds(x, w)[rows][:, None] / 10, y[rows], even, 1e-6) for x, w in zip(views, weights)]
    calibration = np.array([[p[0] / 10, p[1]] for p in pairs])
    both = np.stack([_odds(x, w) * c[0] + c[1] for x, w, c in zip(views, weights, calibration)], 1)
    mixing = _logistic(np.clip(both[rows], -8, 8), y[rows], even, 1e-3)
    return Model(*weights, centre, spread, calibration, mixing)


def _views(batch: pa.RecordBatch, text: int, lang: int, source: int):
    langs, sources = batch.column(lang).to_pylist(), batch.column(source).to_pylist()
    for a, b, data, offsets in T.slices(batch.column(text)):
        yield a, b, data, offsets, metadata(data, offsets, langs[a:b], sources[a:b])


def _inputs(df: DataFrame) -> list:
    """text, lang and source as strings; a missing column counts as null."""
    have = set(df.columns)
    return [(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(f"__{c}")
            for c in ("text", "lang", "source")]


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Co-train on the sample; None without labelled rows of both classes."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.orderBy(*by_hash).limit(LABELLED)
    free = documents.where("doc_id is not null").select("doc_id").join(known, "doc_id", "left_anti")
    free = free.orderBy(*by_hash).limit(UNLABELLED).select("doc_id", F.lit(-1).alias("quality"))
    wanted = {r.doc_id: r.quality for r in chosen.unionByName(free).collect()}
    rows = df_of(documents, wanted)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets, meta in _views(batch, 1, 2, 3):
                content = _content_rows(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], pa.array([r.astype(np.float32).tobytes() for r in content], pa.binary()),
                     pa.array([r.tobytes() for r in meta], pa.binary())], ["doc_id", "content", "meta"])

    got = sorted(rows.mapInArrow(T.lean(run), "doc_id long, content binary, meta binary").collect())
    y = np.array([wanted[r.doc_id] for r in got])
    if len(set(y[y >= 0])) < 2:
        return None
    apart = np.array([crc32(str(r.doc_id).encode()) % 4 == 0 for r in got]) & (y >= 0)
    if len(set(y[(y >= 0) & ~apart])) < 2:
        apart[:] = False
    meta = np.stack([np.frombuffer(r.meta) for r in got])
    content = np.empty((len(got), TRIGRAMS), np.float32)
    for i in range(len(got)):
        content[i], got[i] = np.frombuffer(got[i].content, np.float32), None
    return co_train(content, meta, y, apart)


def df_of(documents: DataFrame, wanted: dict[int, int]) -> DataFrame:
    """The sampled documents (at most LABELLED + UNLABELLED ids), once per id."""
    ids = documents.sparkSession.createDataFrame([(i,) for i in sorted(wanted)], "doc_id long")
    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(documents))
            .join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]))


def _probabilities(model: Model, data: np.ndarray, offsets: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """(texts, 3): content, metadata and combined probability of good quality."""
    odds = np.stack([_odds(_content_rows(data, offsets), model.content),
                     _odds((meta - model.centre) / model.spread, model.metadata)], 1)
    odds = odds * model.calibration[:, 0] + model.calibration[:, 1]
    both = np.clip(odds, -8, 8) @ model.mixing[:-1] + model.mixing[-1]
    return 1 / (1 + np.exp(-np.clip(np.column_stack([odds, both]), -30, 30)))


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, content_score, metadata_score, score (0 to 1: good quality), kept.

    A null text counts as empty; null or missing language and source are no evidence. Null
    ids stay null, repeated rows are scored each, other columns are ignored, an empty table
    gives no rows. Labels other than 0 and 1 and labels without id are ignored, the lowest
    of several counts; without labels of both classes every row has score 1 and is kept.
    """
    model = fit(documents, labels)
    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(documents))
    if model is None:
        return src.select("doc_id", *[F.lit(1.0).alias(c) for c in ("content_score", "metadata_score", "score")],
                          F.lit(True).alias("kept"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets, meta in _views(batch, 1, 2, 3):
                p = _probabilities(shared.value, data, offsets, meta)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= THRESHOLD)],
                    ["doc_id", "content_score", "metadata_score", "score", "kept"])

    return src.mapInArrow(T.lean(run), "doc_id long, content_score double, metadata_score double, score double, kept boolean")


def keep(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not rejected, with its columns."""
    model = fit(documents, labels)
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)
    width = len(documents.columns)
    src = documents.select(*[F.col(f"`{c}`") for c in documents.columns], *_inputs(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width])
            for a, b, data, offsets, meta in _views(batch, width, width + 1, width + 2):
                p = _probabilities(shared.value, data, offsets, meta)[:, 2]
                yield whole.slice(a, b - a).filter(pa.array(p >= THRESHOLD))

    return src.mapInArrow(T.lean(run), documents.schema)
