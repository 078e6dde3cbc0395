"""Near-duplicate vectors by product quantisation.

A coarse quantiser (k-means) deals the vectors into inverted lists; the residual of each
vector is stored as one code per subspace, with the length of its quantisation error. A
query probes the lists nearest to it and reads its distance to a list's codes from a table
per subspace. A vector can only be within the wanted distance if the table distance is
within it plus the vector's own quantisation error, so the tables lose nothing that was
probed; what passes is compared exactly in double precision.

The quantisers are fitted on a bounded sample; every vector is indexed and every vector is a
query. Equal vectors are one node. Lists are cut into blocks of bounded size, and a block
sends counts and a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import components, materialise

#: Vectors the quantisers are fitted on (the smallest hashes).
SAMPLE = 20_000
#: Inverted lists: this times the root of the number of vectors, within bounds.
LISTS_ROOT, LISTS_LEAST, LISTS_MOST = 2, 4, 4096
PROBES = 24
SUBSPACES, CODES, KMEANS_STEPS = 8, 256, 8
#: Rows of a list in one block, as queries or as indexed vectors.
BLOCK = 1024


class Index(NamedTuple):
    """Centroids (lists, dim) and codebooks (subspaces, codes, width); the dimension is padded with zeros."""

    centroids: np.ndarray
    books: np.ndarray
    padded: int


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i:i + 2048], c).argmin(1) for i in range(0, len(x), 2048)]) \
        if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = KMEANS_STEPS) -> np.ndarray:
    """Lloyd's algorithm from distinct rows; an empty cluster keeps its place."""
    c = x[rng.permutation(len(x))[:min(k, len(x))]].copy()
    for _ in range(steps):
        own = _nearest(x, c)
        size = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(size)
        sums = np.add.reduceat(x[order], (np.cumsum(size) - size)[some], axis=0)
        c[some] = sums / size[some][:, None]
    return c


def fit(sample: np.ndarray, lists: int, seed: int = 11) -> Index:
    """Fit both quantisers on unit vectors (rows)."""
    rng = np.random.default_rng(seed)
    padded = -(-sample.shape[1] // SUBSPACES) * SUBSPACES
    x = np.zeros((len(sample), padded))
    x[:, :sample.shape[1]] = sample
    c = kmeans(x, lists, rng)
    rest = x - c[_nearest(x, c)]
    width = padded // SUBSPACES
    books = np.zeros((SUBSPACES, CODES, width))
    for s in range(SUBSPACES):
        b = kmeans(rest[:, s * width:(s + 1) * width], CODES, rng)
        books[s] = np.concatenate([b, np.repeat(b[:1], CODES - len(b), 0)])
    return Index(c, books, padded)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) doubles of a list column whose rows all have ``dim`` values."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim) if dim else np.zeros((len(column), 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, codes, quantisation error, probed lists) of unit vectors."""
    p = np.zeros((len(x), index.padded))
    p[:, :x.shape[1]] = x
    d = _distances(p, index.centroids)
    probes = min(PROBES, d.shape[1])
    near = np.argpartition(d, probes - 1, axis=1)[:, :probes]
    own = d.argmin(1)
    rest = p - index.centroids[own]
    width = index.padded // SUBSPACES
    codes = np.stack([_nearest(rest[:, s * width:(s + 1) * width], index.books[s]) for s in range(SUBSPACES)], 1)
    back = np.concatenate([index.books[s][codes[:, s]] for s in range(SUBSPACES)], 1)
    return own, codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1)), near


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) that connect what the links a-b connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = label != np.arange(len(nodes))
    return nodes[some], nodes[label[some]]


def _block(found: pa.Table, asked: pa.Table, index: Index, dim: int, least: float) -> pa.Table:
    """Links between the indexed rows and the queries of one block of one list."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    if not found.num_rows or not asked.num_rows:
        return none
    cell = found.column("cell")[0].as_py()
    y = _rows(found.column("vec").combine_chunks(), dim)
    x = _rows(asked.column("asked").combine_chunks(), dim)
    codes = np.frombuffer(b"".join(found.column("code").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
    limit = (math.sqrt(max(0.0, 2 - 2 * least)) + found.column("err").to_numpy() + 1e-9) ** 2
    rest = np.zeros((len(x), index.padded))
    rest[:, :dim] = _unit(x)
    rest -= index.centroids[cell]
    width = index.padded // SUBSPACES
    near = np.zeros((len(x), len(y)))
    for s in range(SUBSPACES):
        near += _distances(rest[:, s * width:(s + 1) * width], index.books[s])[:, codes[:, s]]
    i, j = np.nonzero(near <= limit)
    ny, nx = np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1)
    keep = np.concatenate([np.zeros(0, bool)] + [
        np.einsum("ij,ij->i", x[i[k:k + 65536]], y[j[k:k + 65536]]) / (nx[i[k:k + 65536]] * ny[j[k:k + 65536]]) >= least
        for k in range(0, len(i), 65536)])
    i, j = i[keep], j[keep]
    own, other = asked.column("query").to_numpy(), found.column("node").to_numpy()
    apart = own[i] != other[j]
    i, j = i[apart], j[apart]
    if not len(i):
        return none
    links = np.bincount(i, weights=found.column("copies").to_numpy()[j], minlength=len(x)).astype(np.int64)
    # the indexed vector finds the query by itself if it probes the query's list; otherwise the link is counted for it here
    probes, home = found.column("probes").combine_chunks(), asked.column("home").to_numpy()
    probes = probes.flatten().to_numpy().reshape(len(y), -1)
    alone = np.concatenate([np.zeros(0, bool)] + [(probes[j[k:k + 65536]] != home[i[k:k + 65536], None]).all(1)
                                                  for k in range(0, len(i), 65536)])
    back = np.bincount(j[alone], weights=asked.column("weight").to_numpy()[i[alone]], minlength=len(y)).astype(np.int64)
    a, b = _forest(own[i], other[j])
    some, more = np.flatnonzero(links), np.flatnonzero(back)
    return pa.table({"a": pa.array(np.concatenate([a, own[some], other[more]])), "b": pa.array(np.concatenate([b, own[some], other[more]])),
                     "links": pa.array(np.concatenate([np.zeros(len(a), np.int64), links[some], back[more]]))})


def links(nodes: DataFrame, dim: int, least: float) -> DataFrame:
    """(a, b, links) over nodes (node, vec, copies) of one dimension: connecting edges, and for
    rows with a = b a number of linked vectors to be summed per node. A link that only one end's probes find
    is counted for both ends, one that both find once for each."""
    spark = nodes.sparkSession
    count = nodes.count()
    lists = int(min(LISTS_MOST, max(LISTS_LEAST, LISTS_ROOT * math.sqrt(count))))
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vec").toArrow()
    index = fit(_unit(_rows(drawn.column("vec").combine_chunks(), dim)), lists)
    shared = spark.sparkContext.broadcast(index)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, codes, err, near = encode(_unit(_rows(batch.column(1), dim)), shared.value)
            ends = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(err), pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel().astype(np.int32)))],
                ["node", "vec", "copies", "cell", "code", "err", "probes"])

    placed = materialise(nodes.select("node", "vec", "copies").mapInArrow(
        place, f"node long, vec {nodes.schema['vec'].dataType.simpleString()}, copies long, cell int, code binary, err double, probes array<int>"), "index")
    asked = placed.select(F.col("node").alias("query"), F.col("vec").alias("asked"), F.col("copies").alias("weight"), F.col("cell").alias("home"),
                          F.explode("probes").alias("cell"))
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))
    sizes = blocks(placed, "ib").join(blocks(asked, "qb"), "cell")  # a row per list, LISTS_MOST at most
    part = lambda of, n: F.pmod(F.xxhash64(of, F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (placed.join(F.broadcast(sizes), "cell")
            .select("cell", part("node", "ib").alias("i"), every("qb").alias("q"), "node", "vec", "copies", "code", "err", "probes"))
    right = (asked.join(F.broadcast(sizes), "cell")
             .select("cell", every("ib").alias("i"), part("query", "qb").alias("q"), "query", "asked", "weight", "home"))
    by = ["cell", "i", "q"]
    return (left.groupBy(*by).cogroup(right.groupBy(*by))
            .applyInArrow(lambda a, b: _block(a, b, shared.value, dim, least), "a long, b long, links long"))


def near_duplicates(embeddings: DataFrame, least: float = 0.9) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Two vectors link when their cosine in double precision is at least ``least``. Vectors
    that are null, empty or zero, hold null or non-finite components, or have no vec_id link
    with nothing; vectors of different dimensions don't link either. Repeated rows and equal
    vectors are links of each other. ``component_id`` is the smallest vec_id that links
    reach (null without vec_id) and ``kept`` tells that it is the row's own. Other columns
    are ignored; an empty table gives no rows.
    """
    # floats stay as they are; any other numbers become doubles
    vec = F.col("embedding")
    vec = vec if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else vec.cast("array<double>")
    rows = materialise(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")), "vectors")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = (F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite
              & F.exists("vec", lambda v: v != 0))
    tagged = rows.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("vec")))
    nodes = materialise(tagged.where("node is not null").groupBy("node").agg(
        F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("first")), "nodes")
    found = None
    for r in nodes.groupBy(F.size("vec").alias("dim")).count().collect():  # one row per dimension
        part = links(nodes.where(F.size("vec") == r["dim"]), r["dim"], least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    found = materialise(found, "links")
    counts = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("linked"))
    known = (nodes.select("node", "copies", "first").join(counts, "node", "left")
             .join(components(found.select("a", "b")), "node", "left").withColumn("root", F.coalesce("root", "node")))
    firsts = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = materialise(known.join(firsts, "root").select(
        "node", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    return (tagged.select("vec_id", "node").join(known, "node", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
