"""Jaccard self-join of texts on sets of word shingles, by prefix filtering.

1. Every text becomes its sorted set of 64-bit shingle hashes; equal sets are one *node*
   (a 64-bit digest), so copies never meet each other as pairs.
2. An exact pre-filter in hash order: if two sets overlap enough, their extended prefixes
   share several shingles. Nodes that share too few with any other node are done.
3. For the nodes left, shingles are ordered rare first by their exact document frequency.
   A shingle of one node only can join nothing, so only shingles of two nodes or more travel.
4. Nodes meet on prefix shingles. In each shingle's bucket a pivot is compared with the
   others (a star, not all pairs); nodes that the links so far do not connect are then
   compared across components, bucket by bucket, until no candidate pair is left out.
   Length, positional and lone-shingle filters act where two nodes meet; a pair is made once
   and verified by suffix filter and exact overlap.

Links inside a component that add no connection are not listed; no link between different
components is lost, so the components are those of the full join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .storage import components, gather, materialise

#: Extra share of a set that the hash-order prefix holds (step 2); any value is exact.
EXTENSION = 0.1
#: Rounds of pivots before the remaining candidate pairs are made.
PIVOT_ROUNDS = 2
#: Nodes left after the pre-filter are broadcast to their texts up to so many (16 bytes each), and joined beyond.
BROADCAST_NODES = 2_000_000
#: Documents whose intermediate rows make a partition of a written table, at least.
PART_DOCS = 5_000


def _written(df: DataFrame, name: str, rows: int) -> DataFrame:
    return materialise(gather(df, rows, PART_DOCS), name)


def _sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for a, b, data, offsets in T.slices(batch.column(column)):
        yield a, b, T.shingles(*T.words(T.lower(data), offsets), k)


def _node(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def membership(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, node) of each row; an empty set has n = 0 and no node."""
    def run(batches):
        for batch in batches:
            for a, b, sets in _sets(batch, 1, k):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_node(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n", "node"])

    return docs.select("doc_id", "text").mapInArrow(T.lean(run), "doc_id long, n long, node long")


def _prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, need, prefix): the smallest hashes of each set, and how many must be shared with others."""
    def run(batches):
        for batch in batches:
            for _, _, sets in _sets(batch, 0, k):
                sets = [s for s in sets if len(s)]
                cut = [len(s) - -(-percent * len(s) // 100) + int(EXTENSION * len(s)) + 1 for s in sets]
                need = [int(EXTENSION * (percent * len(s) // 100)) + 1 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(s) for s in sets], pa.int64()), pa.array(need, pa.int32()),
                     _lists([s[:c] for s, c in zip(sets, cut)])], ["node", "need", "prefix"])

    return docs.select("text").mapInArrow(T.lean(run), "node long, need int, prefix array<long>")


def _survivors(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, n, hashes) of the nodes that may have a link, each from one of its documents."""
    rows = members.count()
    entries = _prefixes(docs, k, percent).select("node", "need", F.explode("prefix").alias("h"))
    shared = _written(entries.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b"))
                      .where("a <> b").select("h"), "shared", rows)
    # copies of one node send the same entries: counted once per document, so the count is divided
    seen = (entries.join(shared, "h").groupBy("node").agg(F.count("*").alias("hits"), F.first("need").alias("need")))
    nodes = members.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    alive = _written(seen.join(nodes, "node").where("hits >= need * copies").select("node", "doc_id"), "alive", rows)

    def run(batches):
        for batch in batches:
            for a, b, sets in _sets(batch, 1, k):
                want = batch.column(0)[a:b].to_pylist()
                kept = [(w, s) for w, s in zip(want, sets) if len(s) and _node(s) == w]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in kept], pa.int64()), pa.array([len(s) for _, s in kept], pa.int64()),
                     _lists([s for _, s in kept])], ["node", "n", "hashes"])

    few = alive.count() <= BROADCAST_NODES
    texts = docs.select("doc_id", "text").join(F.broadcast(alive) if few else alive, "doc_id").select("node", "text")
    sets = texts.mapInArrow(T.lean(run), "node long, n long, hashes array<long>")
    return _written(sets.dropDuplicates(["node"]), "sets", rows)


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """(h, node, n, pos, alone) of prefix shingles that two nodes or more hold, in rare-first order;
    ``alone`` counts the shingles that only this node holds, which come first."""
    entries = sets.select("node", F.explode("hashes").alias("h"))
    df = entries.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    common = (entries.join(df, "h").groupBy("node")
              .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common")))
    n, alone = F.col("n"), F.col("n") - F.size("common")
    cut = (n - F.ceil(n * percent / F.lit(100)) + 1 - alone).cast("int")
    return (common.join(sets.select("node", "n"), "node").where(cut > 0)
            .select("node", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), cut)))
            .select(F.col("col.h").alias("h"), "node", "n", (F.col("alone") + F.col("pos")).alias("pos"), "alone"))


def _may_link(percent: int) -> Column:
    """Length, prefix, positional and lone-shingle filters on two entries x and y of one shingle.

    Only the shorter set's index prefix can hold the first common shingle. The overlap is at
    most what follows the shingle in either set, and at most what a set shares with anyone;
    the union holds the overlap and the lone shingles of both.
    """
    nx, ny, px, py, sx, sy = (F.col(c) for c in ("x.n", "y.n", "x.pos", "y.pos", "x.alone", "y.alone"))
    least = F.ceil((nx + ny) * percent / F.lit(100 + percent))
    x_first = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
    short, at = F.when(x_first, nx).otherwise(ny), F.when(x_first, px).otherwise(py)
    return ((F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent)
            & (at <= short - F.ceil(short * 2 * percent / F.lit(100 + percent)))
            & (F.least(nx - px, ny - py) >= least)
            & ((100 - percent) * F.least(nx - sx, ny - sy) >= percent * (sx + sy)))


def _pairs(met: DataFrame) -> DataFrame:
    """Each pair once, smaller node first."""
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _star(labelled: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each bucket's pivot with the members that no link connects with it yet."""
    # first the most central member, with the fewest rare shingles before the bucket's; then any
    rank = F.col("pos") / F.col("n") if not turn else F.xxhash64("node", F.lit(turn))
    whole = F.struct("node", "n", "pos", "alone", "root")
    pivots = (labelled.groupBy("h").agg(F.min_by(whole, F.struct(rank.alias("rank"), F.col("node"))).alias("p"),
                                        F.min("root").alias("low"), F.max("root").alias("high"))
              .where("low <> high").select("h", "p.*"))
    x, y = labelled.alias("x"), pivots.alias("y")
    return _pairs(x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root")) & _may_link(percent)))


def _across(labelled: DataFrame, percent: int, rows: int) -> DataFrame:
    """All candidate pairs between different components of a bucket.

    Components of a bucket are held against each other by their best figures first, so two
    members of one component never meet, and only components that may link are opened: the
    smaller one first, then the larger one under the filters of single pairs.
    """
    q = 100 + percent
    shared = (100 - percent) * (F.col("n") - F.col("alone")) - percent * F.col("alone")
    groups = labelled.groupBy("h", "root").agg(
        F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("alone").alias("lone"),
        F.max(shared).alias("shared"), F.max(q * (F.col("n") - F.col("pos")) - percent * F.col("n")).alias("after"))
    several = groups.groupBy("h").agg(F.count("*").alias("roots")).where("roots > 1").select("h")
    groups = _written(groups.join(several, "h"), "groups", rows)
    f = {k: (F.col(f"f.{k}"), F.col(f"g.{k}")) for k in groups.columns}
    fits = (f["h"][0] == f["h"][1]) & (F.struct("f.size", "f.root") < F.struct("g.size", "g.root"))
    for i, j in ((0, 1), (1, 0)):
        fits &= ((f["high"][i] * 100 >= f["low"][j] * percent) & (f["shared"][i] >= percent * f["lone"][j])
                 & (f["after"][i] >= percent * f["low"][j]))
    roots = groups.alias("f").join(groups.alias("g"), fits).select("f.h", F.col("f.root").alias("root"),
                                                                  F.col("g.root").alias("other"))
    small = labelled.join(roots, ["h", "root"])
    x, y = small.alias("x"), labelled.alias("y")
    return _pairs(x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.other") == F.col("y.root")) & _may_link(percent)))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """A lower bound of the symmetric difference of two sorted sets: split both at the middle
    value of the larger one and add the bounds of the halves."""
    if not depth or len(x) < 2 or len(y) < 2:
        return abs(len(x) - len(y))
    if len(x) < len(y):
        x, y = y, x
    i = len(x) // 2
    j = int(np.searchsorted(y, x[i]))
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y| for sorted distinct arrays."""
    if not len(x) or not len(y):
        return False
    total = len(x) + len(y)
    least = -(-percent * total // (100 + percent))
    if suffix_bound(x, y, 4) > total - 2 * least:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= least


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            x, y = batch.column("x"), batch.column("y")
            keep = pa.array([similar(x[i].values.to_numpy().view(np.uint64), y[i].values.to_numpy().view(np.uint64),
                                     percent) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    side = lambda node, col: sets.select(F.col("node").alias(node), F.col("hashes").alias(col))
    return (pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
            .mapInArrow(T.lean(run), "a long, b long"))


def _as(entries: DataFrame, node: str, n: str, pos: str, *rest: str) -> DataFrame:
    return entries.select("h", F.col("node").alias(node), F.col("n").alias(n), F.col("pos").alias(pos), *rest)


def similarity_links(docs: DataFrame, members: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """(a, b): verified links between nodes that connect what the full join connects."""
    sets = _survivors(docs, members, k, percent)
    rows = members.count()
    entries = _written(_rare_first(sets, percent), "prefix", rows)
    links, labelled = None, entries.withColumn("root", F.col("node"))
    for turn in range(PIVOT_ROUNDS):
        found = _written(_verify(_star(labelled, turn, percent), sets, percent), "links", rows)
        links = found if links is None else links.unionByName(found)
        labelled = _written(_label(entries, links), "labelled", rows)
    last = _written(_verify(_across(labelled, percent, rows), sets, percent), "links", rows)
    return links.unionByName(last)


def _label(entries: DataFrame, links: DataFrame) -> DataFrame:
    return (entries.join(components(links), "node", "left")
            .select("h", "node", "n", "pos", "alone", F.coalesce("root", "node").alias("root")))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A set holds the distinct k-word shingles of the lower-cased text; a text of fewer words
    is one shingle. Two documents link when 100 * |intersection| >= percent * |union|;
    ``component_id`` is the smallest doc_id that links reach. A null, empty or blank text
    has n_shingles 0 and its own doc_id. A row without doc_id takes no part: it comes back
    with null component_id. Repeated rows are copies of each other. Other columns are
    ignored; an empty table gives no rows. Hashes are of 64 bits.
    """
    members = materialise(membership(docs, k), "members")
    known = members.where("doc_id is not null")
    some = docs.select("doc_id", "text").where("doc_id is not null")
    linked = components(similarity_links(some, known, percent, k))
    nodes = known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    nodes = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = _written(nodes.join(firsts, "root").select("node", "component_id"), "classes", members.count())
    return (members.join(classes, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def representatives(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component, with its columns.

    Repeated rows of one doc_id all stay or all go; rows without doc_id stay.
    """
    groups = near_duplicates(docs, percent, k).where("doc_id <> component_id")
    gone = materialise(groups.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
