"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the vocabulary of the benchmark, with document frequencies
counted over all documents. A randomised SVD, computed on Spark from the benchmark's items
and all documents, gives a latent space of ``RANK`` dimensions. Every passage of every document is folded into it and compared with all items by cosine.
Candidates are checked on the words themselves: the longest common subsequence with the item
must cover most of it, and most of its rarest words, which carry the answer, must be there.

Passages are overlapping windows of the power of two at or below an item's length, so one
lies inside any copy of an item. A passage most of whose weight is on words that the
benchmark doesn't have cannot be near an item and is not folded in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

RANK, OVERSAMPLING = 64, 16
#: Words of a fitting passage; words whose rows are gathered at a time.
FIT_WORDS, GATHER = 32, 1_024
#: Items compared at a time; a larger benchmark is searched in several blocks.
ITEMS = 5000
#: Least share of a passage's weight on benchmark words, least latent cosine.
SHARE, COSINE = 0.45, 0.4
#: Least share of an item in the common subsequence, and of its rarest words.
COVER, ANSWER_WORDS, ANSWER = 0.7, 6, 0.5


class Benchmark(NamedTuple):
    """Items as vocabulary ids, their rarest words, the vocabulary's hashes in ascending order, its weights and latent space."""

    ids: list
    items: list[np.ndarray]
    rare: list[tuple[int, ...]]
    vocabulary: np.ndarray
    idf: np.ndarray
    other: float
    space: np.ndarray
    folded: np.ndarray


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, words before each text) of lower-cased letters and digits."""
    low = T.lower(data)
    starts, ends, counts = T.word_spans(low, offsets, T.NOT_PLAIN)
    return T.span_hashes(low, starts, ends), counts


def look_up(hashes: np.ndarray, vocabulary: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Vocabulary id of each word, -1 for others; ``mask`` tells which low 20 bits occur."""
    out = np.full(len(hashes), -1, np.int32)
    maybe = np.flatnonzero(mask[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
    at = np.searchsorted(vocabulary, hashes[maybe])
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == hashes[maybe]
    out[maybe[hit]] = at[hit]
    return out


def bit_mask(vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return out


def windows(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of half-overlapping windows of ``width`` words; a text's last one ends with it."""
    n = np.diff(counts)
    step = max(1, width // 2)
    per = np.where(n > 0, 1 + np.maximum(0, -(-(n - width) // step)), 0)
    own = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
    start = counts[own] + np.minimum(nth * step, np.maximum(0, n[own] - width))
    return own, start, np.minimum(start + width, counts[own + 1])


def _folds(words: np.ndarray, idf: np.ndarray, m: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of word ranges times ``m``, for vocabulary ids (-1: no weight)."""
    out = np.zeros((len(start), m.shape[1]), np.float32)
    rows = (m * idf[:, None]).astype(np.float32)
    rows = np.concatenate([rows, np.zeros((1, m.shape[1]), np.float32)])  # id -1
    for i in range(0, len(start), 4096):
        a, b = start[i:i + 4096], end[i:i + 4096]
        lens = b - a
        first = np.cumsum(lens) - lens
        at = np.arange(lens.sum()) - np.repeat(first - a, lens)
        out[i:i + 4096] = np.add.reduceat(rows[words[at]], first, axis=0)
    return out


def lcs(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``x``."""
    at: dict[int, int] = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << i
    every = (1 << len(x)) - 1
    v = every
    for w in y:
        m = v & at.get(w, 0)
        v = ((v + m) | (v - m)) & every
    return len(x) - v.bit_count()


def search(data: np.ndarray, offsets: np.ndarray, bench: Benchmark, mask: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
    """(text, item, cosine, cover) of the items found in the texts of a slice."""
    hashes, counts = plain_words(data, offsets)
    if not len(hashes):
        return
    words = look_up(hashes, bench.vocabulary, mask)
    known = words >= 0
    weight = np.where(known, bench.idf[words], bench.other) ** 2
    total = np.concatenate(([0], np.cumsum(weight)))
    inside = np.concatenate(([0], np.cumsum(weight * known)))
    length = np.array([len(i) for i in bench.items])
    widths = 1 << np.floor(np.log2(length)).astype(int)
    done = set()
    for width in np.unique(widths).tolist():
        chosen = np.flatnonzero(widths == width)
        own, start, end = windows(counts, width)
        near = inside[end] - inside[start] >= SHARE * (total[end] - total[start])
        own, start, end = own[near], start[near], end[near]
        for k in range(0, len(own), 8192):
            s, e = start[k:k + 8192], end[k:k + 8192]
            p = _folds(words, bench.idf, bench.space, s, e)
            p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
            cos = p @ bench.folded[chosen].T
            for i in np.flatnonzero((cos >= COSINE).any(1)).tolist():
                text = int(own[k + i])
                low, high = int(counts[text]), int(counts[text + 1])
                around = words[max(low, int(s[i]) - 2 * width):min(high, int(e[i]) + 2 * width)].tolist()
                have = set(around)
                for j in np.flatnonzero(cos[i] >= COSINE).tolist():
                    item = int(chosen[j])
                    if (text, item) in done or len(have.intersection(bench.rare[item])) < ANSWER * len(bench.rare[item]):
                        continue
                    cover = lcs(bench.items[item].tolist(), around) / len(bench.items[item])
                    if cover >= COVER:
                        done.add((text, item))
                        yield text, item, float(cos[i, j]), cover


def _gram(words: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray, idf: np.ndarray, y: np.ndarray) -> None:
    """Add the passages' part of (A' A m) / idf to ``y``; A has a passage's TF-IDF vector, of length 1, in each row.

    ``words`` are vocabulary ids (-1: none), the ranges ascend, ``rows`` is m times idf. Ranges overlap, so words are
    summed once between the places where a range begins or ends, and get the sum of the ranges around them.
    """
    before = np.concatenate(([0], np.cumsum(words >= 0)))
    known, start, end = words[words >= 0], before[start], before[end]
    start, end = start[start < end], end[start < end]
    if not len(start):
        return
    cuts = np.unique(np.concatenate((start, end)))
    first, last = np.searchsorted(cuts, start), np.searchsorted(cuts, end)
    square = np.concatenate(([0], np.cumsum(idf[known] ** 2)))
    sums = np.zeros((len(cuts), rows.shape[1]))  # before each cut
    segment = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))  # of each known word in a range
    known = known[cuts[0]:cuts[-1]]
    for a in range(0, len(known), GATHER):
        own = segment[a:a + GATHER]
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        sums[own[at] + 1] += np.add.reduceat(rows[known[a:a + GATHER]], at, axis=0)
    np.cumsum(sums, axis=0, out=sums)
    p = (sums[last] - sums[first]) / np.maximum(square[end] - square[start], 1e-9)[:, None]
    sums[:] = 0
    for edge, sign in ((first, 1), (last, -1)):
        at = np.flatnonzero(np.concatenate(([True], edge[1:] != edge[:-1])))
        sums[edge[at]] += sign * np.add.reduceat(p, at, axis=0)
    around = np.cumsum(sums, axis=0).astype(np.float32)
    order = np.argsort(known, kind="stable")
    known, segment = known[order], segment[order]
    for a in range(0, len(known), GATHER):
        some = known[a:a + GATHER]
        at = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
        y[some[at]] += np.add.reduceat(around[segment[a:a + GATHER]], at, axis=0)


def _svd(passages: DataFrame, vocabulary: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Leading right singular vectors (words, RANK) of the passages' TF-IDF matrix.

    Randomised: one product Y of the Gram matrix G with a thin matrix W, summed by word on Spark. G is
    taken as Y (W'Y)^-1 Y' (Nystroem), so the vectors lie in the range of G W. Only matrices of vocabulary
    times ``RANK + OVERSAMPLING`` pass the driver.
    """
    size = min(RANK + OVERSAMPLING, len(vocabulary))
    spark = passages.sparkSession
    names = [f"y{k}" for k in range(size)]

    def gram(m: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((vocabulary, idf, (m * idf[:, None]).astype(np.float32)))

        def run(batches):
            vocabulary, idf, rows = shared.value
            mask = bit_mask(vocabulary)
            y = np.zeros((len(vocabulary), rows.shape[1]))
            for batch in batches:
                for _, _, data, offsets in T.slices(batch.column(0), T.SLICE_BYTES // 8):
                    hashes, counts = plain_words(data, offsets)
                    _, start, end = windows(counts, FIT_WORDS)
                    _gram(look_up(hashes, vocabulary, mask), start, end, rows, idf, y)
            some = np.flatnonzero(y.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(c) for c in y[some].T)],
                                             ["word", *names])

        parts = passages.mapInArrow(T.lean(run), "word int, " + ", ".join(f"{c} double" for c in names))
        got = parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
        out = np.zeros((len(vocabulary), size))
        out[got["word"].to_numpy()] = got[names].to_numpy()
        return out * idf[:, None]

    thin = np.linalg.qr(np.random.default_rng(5).normal(size=(len(vocabulary), size)))[0]
    y = gram(thin)
    values, turn = np.linalg.eigh((thin.T @ y + y.T @ thin) / 2)
    some = values > 1e-6 * values[-1]  # below is the rounding of the sums
    return np.linalg.svd(y @ (turn[:, some] / np.sqrt(values[some])), full_matrices=False)[0][:, :RANK]


def prepare(documents: DataFrame, benchmark: DataFrame) -> list[Benchmark]:
    """The benchmark in blocks of ``ITEMS``, each with vocabulary, weights and latent space.

    Items without a word or an id are left out.
    """
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = -(-items.count() // ITEMS)
    out = []
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = sorted((r.item_id, r.text) for r in part.collect())
        column = pa.array([t for _, t in rows], pa.large_string())
        texts = []
        for _, _, data, offsets in T.slices(column):
            hashes, counts = plain_words(data, offsets)
            texts += [hashes[a:b] for a, b in zip(counts[:-1], counts[1:])]
        kept = [k for k, t in enumerate(texts) if len(t)]
        if not kept:
            continue
        vocabulary = np.unique(np.concatenate([texts[k] for k in kept]))
        idf, other = _weights(documents, vocabulary)
        space = _svd(documents.select("text").unionByName(part.select("text")), vocabulary, idf)
        words = [np.searchsorted(vocabulary, texts[k]).astype(np.int32) for k in kept]
        ends = np.cumsum([len(w) for w in words])
        folded = _folds(np.concatenate(words), idf, space, ends - [len(w) for w in words], ends)
        folded /= np.maximum(np.linalg.norm(folded, axis=1, keepdims=True), 1e-12)
        out.append(Benchmark([rows[k][0] for k in kept], words,
                             [tuple(np.unique(w[np.argsort(-idf[w], kind="stable")[:ANSWER_WORDS]]).tolist()) for w in words],
                             vocabulary, idf, other, space.astype(np.float32), folded))
    return out


def _weights(documents: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse document frequency of the vocabulary over all documents, and the weight of other words."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        mask = bit_mask(shared.value)
        df, n = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            for a, b, data, offsets in T.slices(batch.column(0)):
                hashes, counts = plain_words(data, offsets)
                words = look_up(hashes, shared.value, mask)
                own = np.repeat(np.arange(b - a), np.diff(counts))
                pairs = np.unique(own[words >= 0].astype(np.int64) * len(df) + words[words >= 0])
                df += np.bincount(pairs % len(df), minlength=len(df))
                n += b - a
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)),
                                          pa.array(np.append(df[some], n))], ["word", "df"])

    rows = documents.select("text").mapInArrow(T.lean(run), "word int, df long").groupBy("word").agg(F.sum("df").alias("df"))
    df = {r.word: r.df for r in rows.collect()}  # a row per benchmark word
    n = df.pop(-1, 0)
    counts = np.zeros(len(vocabulary))
    for word, c in df.items():
        counts[word] = c
    idf = np.log((n + 1) / (counts + 1)) + 0.1
    return idf, float(idf.mean())


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, cosine, cover.

    ``cover`` is the share of the item's words in the longest common subsequence. Documents
    without a row are clean. Null and empty texts and rows without doc_id have no rows;
    repeated rows count once; other columns are ignored; an empty table on either side gives
    no rows. Texts are searched whole.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    schema = "doc_id long, item_id long, cosine double, cover double"
    found = documents.sparkSession.createDataFrame([], schema)
    for bench in prepare(docs, benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(bench)

        def run(batches, shared=shared):
            mask = bit_mask(shared.value.vocabulary)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for a, _, data, offsets in T.slices(batch.column(1)):
                    rows = [(ids[a + t], shared.value.ids[i], c, v) for t, i, c, v in
                            search(data, offsets, shared.value, mask)]
                    cols = list(zip(*rows)) or [()] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                        ["doc_id", "item_id", "cosine", "cover"])

        found = found.unionByName(docs.mapInArrow(T.lean(run), schema))
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("cover").alias("cover"))


def keep(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` in which no item is found, with its columns."""
    out, names = documents, documents.columns
    where = names.index("text")
    for bench in prepare(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(bench)

        def run(batches, shared=shared):
            mask = bit_mask(shared.value.vocabulary)
            for batch in batches:
                for a, b, data, offsets in T.slices(batch.column(where)):
                    clean = np.ones(b - a, bool)
                    clean[[t for t, *_ in search(data, offsets, shared.value, mask)]] = False
                    yield batch.slice(a, b - a).filter(pa.array(clean))

        out = out.mapInArrow(T.lean(run), documents.schema)
    return out
