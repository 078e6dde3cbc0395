"""Passages that repeat across documents, found by content-defined chunking.

A gear rolling hash over the last ``REACH`` bytes cuts each text into variable chunks, so a
passage is cut alike wherever it stands and whatever was inserted before it. Chunks are
grouped by digest; one that occurs in two documents or more is an anchor. A window of
``MIN_WORDS`` words without a chunk that is long enough has a shingle of its words as anchor. Runs of anchors
that can belong to a passage of ``MIN_WORDS`` words mark regions of a document, and every window of
``MIN_WORDS`` words in a region is hashed, once per document. Windows of equal hash in two documents
are repeated; runs of them are the passages, to the word. No two texts are ever compared, so
the work is linear in the texts however often a line or a passage repeats. Documents of equal text are one
until the end: the first one's windows stand for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .storage import materialise

#: Bytes that the rolling hash reaches back, and one boundary in so many bytes.
REACH, ONE_IN = 16, 16
#: Chunks shorter than this are no anchors; longer ones are cut.
LEAST, MOST = 16, 256
#: Words of a passage.
MIN_WORDS = 50
#: Words of the anchors in windows without a chunk that is long enough.
SHINGLE = 10
#: Documents with regions are broadcast to the texts up to so many ids, and joined beyond.
BROADCAST_DOCS = 500_000
#: Windows that a worker hands on at a time.
EMIT = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bases (odd) of the two hashes of a window, and their inverses.
_BASES = [(np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
_GEAR = T.mix64(np.arange(1, 257, dtype=np.uint64)).astype(np.uint16)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, starts before long chunks were cut) of all texts; a chunk never spans two texts."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    gear = _GEAR[data]
    h = gear.copy()
    for j in range(1, min(REACH, n)):
        h[j:] += gear[:-j] << np.uint16(j)
    cut = (h >> np.uint16(16 - (ONE_IN.bit_length() - 1))) == 0
    for j in range(REACH - 1):  # the hash would reach into the text before
        at = offsets[:-1] + j
        cut[at[at < offsets[1:]]] = False
    cut[offsets[1:][offsets[1:] > 0] - 1] = True  # a text's last byte ends a chunk
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate(([0], ends[:-1]))
    parts, whole = -(-(ends - starts) // MOST), starts
    if parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = np.repeat(starts, parts)
        starts = whole + nth * MOST
        ends = np.minimum(np.repeat(ends, parts), starts + MOST)
    return starts, ends, whole


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text of each anchor, starts, ends, uncut starts, digests)."""
    starts, ends, whole = chunks(data, offsets)
    long = ends - starts >= LEAST
    starts, ends, whole = starts[long], ends[long], whole[long]
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends, whole, T.span_hashes(data, starts, ends)


def window_anchors(data: np.ndarray, offsets: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each anchor, starts, digests) for windows of ``least`` words without an anchor inside.

    Each has its shingle with the smallest hash as anchor, which depends on the window's bytes
    alone: equal windows have an anchor in common whatever stands around them.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word, stop, counts = T.word_spans(data, offsets)
    n = np.diff(counts) - least + 1
    n = np.maximum(n, 0)
    if not n.sum():
        return none
    own = np.repeat(np.arange(len(n)), n)
    first = counts[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    _, _, ends, whole, _ = anchors(data, offsets)
    # boundaries in the first REACH bytes of a window depend on what stands before it
    at = np.searchsorted(whole, word[first] + REACH)
    bare = np.append(ends, len(data) + 1)[at] > stop[first + least - 1]
    own, first = own[bare], first[bare]
    if not len(first):
        return none
    k = min(SHINGLE, least)
    mark = np.zeros(len(word) + 1, np.int32)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + least, -1)
    used = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    hashes = np.zeros(len(word), np.uint64)
    hashes[used] = T.span_hashes(data, word[used], stop[used])
    rolled = np.zeros(len(word) - k + 1, np.uint64)
    for j in range(k):
        rolled = rolled * _BASE + hashes[j:j + len(rolled)]
    rolled = T.mix64(rolled + np.uint64(SHINGLE))
    chosen = np.concatenate([f + rolled[f[:, None] + np.arange(least - k + 1)].argmin(1)
                             for f in np.array_split(first, -(-len(first) // 16384))])
    chosen, at = np.unique(chosen, return_index=True)
    return own[at], word[chosen], rolled[chosen]


def anchor_table(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, nth, digest, since, until): ``since`` to ``until`` are the words from the anchor
    before to the anchor behind (or the ends of the text): a common passage with this anchor
    and none of its neighbours lies between them. Boundaries in the first ``REACH`` bytes of a
    passage depend on what stands before it, so ``since`` goes back as far. Anchors of windows
    have no ``nth``; theirs are the words that windows around them reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, data, offsets in T.slices(batch.column(1)):
                word, _, counts = T.word_spans(data, offsets)
                own, at, digest = window_anchors(data, offsets, least)
                if len(own):
                    place = np.searchsorted(word, at) - counts[own]
                    since = np.maximum(place + min(SHINGLE, least) - least, 0)
                    until = np.minimum(place + least, np.diff(counts)[own])
                    order = np.lexsort((digest, own))  # periodic texts repeat one digest
                    own, digest, since, until = own[order], digest[order], since[order], until[order]
                    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (digest[1:] != digest[:-1]))))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a + own[new]]), pa.nulls(len(new), pa.int32()), pa.array(digest[new].view(np.int64)),
                         pa.array(np.minimum.reduceat(since, new).astype(np.int32)),
                         pa.array(np.maximum.reduceat(until, new).astype(np.int32))], ["doc_id", "nth", "digest", "since", "until"])
                own, starts, ends, whole, digest = anchors(data, offsets)
                if not len(own):
                    continue
                first = np.concatenate(([True], own[1:] != own[:-1]))
                last = np.concatenate((own[1:] != own[:-1], [True]))
                base = counts[own]
                since = np.maximum(np.searchsorted(word, whole - REACH) - base, 0)
                until = np.searchsorted(word, ends) - base
                since = np.where(first, 0, np.concatenate(([0], since[:-1])))
                until = np.where(last, counts[own + 1] - base, np.concatenate((until[1:], [0])))
                begin = np.flatnonzero(first)
                nth = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a + own]), pa.array(nth.astype(np.int32)), pa.array(digest.view(np.int64)),
                     pa.array(since.astype(np.int32)), pa.array(until.astype(np.int32))],
                    ["doc_id", "nth", "digest", "since", "until"])

    return docs.mapInArrow(T.lean(run), "doc_id long, nth int, digest long, since int, until int")


def _regions(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, since, until): words of a document that may belong to a passage of another one."""
    table = materialise(anchor_table(docs, least), "anchors")
    shared = (table.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
              .where("low <> high").select("digest"))
    repeated = table.join(materialise(shared, "shared"), "digest").select("doc_id", "nth", "since", "until")
    order = Window.partitionBy("doc_id").orderBy("nth")
    runs = (repeated.where("nth is not null").withColumn("run", F.col("nth") - F.dense_rank().over(order))
            .groupBy("doc_id", "run").agg(F.min("since").alias("since"), F.max("until").alias("until")))
    return (runs.where(F.col("until") - F.col("since") >= least).select("doc_id", "since", "until")
            .unionByName(repeated.where("nth is null").select("doc_id", "since", "until")))


def window_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each byte span; spans may overlap, the work is linear in the text."""
    terms, sizes, out = data.astype(np.uint64) + np.uint64(1), (ends - starts).astype(np.uint64), []
    for base, inverse in _BASES:
        # sums of (byte + 1) * base ** position, over the power of the span's start
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms * _powers(base, len(data)), dtype=np.uint64)))
        out.append(T.mix64((total[ends] - total[starts]) * _powers(inverse, len(data) + 1)[starts] + sizes * base))
    return out


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def windows(regions: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(w1, w2, doc_id, top, nth, start, end): the windows of ``least`` words in the regions of each document.

    ``regions`` has doc_id, text, ``top`` and an array ``around`` of word ranges; every window of a range
    is a row, whole words from ``start`` to ``end`` in bytes, equal windows of one document included.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, top, text, around in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                data = np.frombuffer(text.as_py(), np.uint8)
                word, stop, _ = T.word_spans(data, np.array([0, len(data)]))
                n = len(word) - least + 1
                if n <= 0:
                    continue
                mark = np.zeros(n + 1, np.int64)
                for r in around:
                    first, last = min(r["since"], n), min(r["until"] - least + 1, n)
                    if first < last:
                        mark[first] += 1
                        mark[last] -= 1
                at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                if not len(at):
                    continue
                # only the bytes between the first and the last window
                low, high = int(word[at[0]]), int(stop[at[-1] + least - 1])
                start, end = word[at], stop[at + least - 1]
                w1, w2 = window_hashes(data[low:high], start - low, end - low)
                for a in range(0, len(at), EMIT):
                    b = min(len(at), a + EMIT)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w1[a:b].view(np.int64)), pa.array(w2[a:b].view(np.int64)), pa.array(np.full(b - a, i)),
                         pa.array(np.full(b - a, top)), pa.array(at[a:b].astype(np.int32)), pa.array(start[a:b]), pa.array(end[a:b])],
                        ["w1", "w2", "doc_id", "top", "nth", "start", "end"])

    return (regions.select("doc_id", "top", F.col("text").cast("binary").alias("text"), "around")
            .mapInArrow(T.lean(run), "w1 long, w2 long, doc_id long, top long, nth int, start long, end long"))


def repeated_passages(documents: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage of a document: doc_id, start and end (bytes of its UTF-8
    text), n_words, first_doc_id (the smallest document it was found in), kept.

    A passage is a longest run of windows of ``least`` words that other documents have, all of them windows
    that the document is the first to have (``kept``) or all of them found in an earlier one; those may be cut
    (``remove``). Null, empty and short texts have no rows, nor have rows without doc_id; repeated rows of
    one doc_id are one document; other columns are ignored; an empty table gives no rows.
    Passages repeated inside one document only are not reported. Of documents with equal texts the first has
    the passages; each other one has its whole text as one, from its first word to its last.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        "doc_id is not null and text is not null")
    digests = materialise(docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    equal = (digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("top"))
             .where("first <> top"))
    equal = materialise(equal, "equal")
    copies = materialise(digests.join(equal, "digest").where("doc_id <> first").select("doc_id", "first").distinct(), "copies")
    # the first of equal documents is searched whole: all of its windows repeat
    whole = equal.select(F.col("first").alias("doc_id"), F.lit(0).alias("since"), F.lit((1 << 31) - 1).alias("until"), "top")
    regions = (_regions(docs, least).join(copies.select("doc_id"), "doc_id", "left_anti")
               .select("*", F.lit(None).cast("long").alias("top")).unionByName(whole)
               .groupBy("doc_id").agg(F.max("top").alias("top"), F.collect_list(F.struct("since", "until")).alias("around")))
    regions = materialise(regions.withColumn("top", F.coalesce("top", "doc_id")), "regions")
    beside = F.broadcast(regions) if regions.count() <= BROADCAST_DOCS else regions
    found = materialise(windows(docs.join(beside, "doc_id"), least), "windows")
    shared = (found.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("top").alias("high"))
              .where("low <> high").select("w1", "w2", "low"))
    repeated = (found.join(shared, ["w1", "w2"])
                .select("doc_id", "nth", "start", "end", "low", (F.col("low") == F.col("doc_id")).alias("kept")))
    order = Window.partitionBy("doc_id", "kept").orderBy("nth")
    passages = materialise(
        repeated.withColumn("run", F.col("nth") - F.dense_rank().over(order)).groupBy("doc_id", "kept", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("nth") - F.min("nth") + least).cast("long").alias("n_words"),
             F.min("low").alias("first_doc_id"), F.min("nth").alias("nth")), "passages")
    # windows stand at every word of the first of equal documents, so its runs reach from its first word to its last
    spans = (passages.join(equal.select(F.col("first").alias("doc_id")).distinct(), "doc_id")
             .groupBy(F.col("doc_id").alias("first")).agg(
                 F.min("start").alias("start"), F.max("end").alias("end"),
                 (F.max(F.col("nth") + F.col("n_words")) - F.min("nth")).alias("n_words"), F.min("first_doc_id").alias("first_doc_id")))
    names = ["doc_id", "start", "end", "n_words", "first_doc_id", "kept"]
    of_copies = copies.join(spans, "first").withColumn("kept", F.lit(False)).select(*names)
    return passages.select(*names).unionByName(of_copies)


def remove(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """``documents`` with the passages cut that are not kept; all columns and rows stay."""
    cuts = (passages.where(~F.col("kept")).groupBy(F.col("doc_id").alias("__id"))
            .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts")))
    names = documents.columns
    joined = documents.join(cuts, F.col("doc_id") == F.col("__id"), "left").select(*names, "__cuts")
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts_ in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist()):
                if text is not None and cuts_:
                    raw, out, at = text.encode(), [], 0
                    for c in cuts_:
                        out.append(raw[at:max(at, c["start"])])
                        at = max(at, c["end"])
                    text = b"".join([*out, raw[at:]]).decode()
                texts.append(text)
            cols = batch.columns[:len(names)]
            cols[where] = pa.array(texts, batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(T.lean(run), documents.schema)
