"""Byte-level BPE encoding and decoding with a public rank file.

Pre-tokenisation finds the matches of ``public_tokenizers.PATTERN`` without a regular
expression. Every code point has a class (letter, number, white space, other); a few
look-ahead facts refine it (is the next code point white space, does an apostrophe begin a
contraction). The pattern is then a transition function on ``STATES`` per code point, and
the state before each code point is the composition of all functions to its left. The
compositions form a small finite monoid, so they are scanned associatively: prefix products
inside fixed blocks, products over blocks, then the carry into each block.

The slices go through a bounded cache of merged pieces. Token offsets (bytes) are kept, so
that a decoder can cut any token range.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

CACHE_PIECES = 200_000  # in each of two generations
#: Pieces longer than this are merged each time, so that the cache is bounded in bytes.
CACHE_BYTES_EACH = 64
BLOCK = 128
#: Texts of a batch are encoded together up to this many bytes.
GROUP_BYTES = 1 << 18

# Classes of a code point after look-ahead.
LETTER, NUMBER, OTHER, SHORT, LONG, INSIDE, BLANK, BREAK, RESET = range(9)
# States before a code point: what the token to the left is.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8

#: White space of the pattern's \s (fixed values: the Unicode property White_Space).
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
               0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Contractions of the pattern (fixed values).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a token begin here) by [class, state]."""
    step = np.zeros((9, STATES), np.uint8)
    begin = np.ones((9, STATES), bool)
    for kind, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        step[kind] = run
        begin[kind, [run, AFTER_BLANK]] = False
    for kind, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        step[kind] = left
        step[kind, [IN_OTHER, AFTER_BLANK]] = IN_OTHER
        begin[kind, [IN_OTHER, AFTER_BLANK]] = False
    step[INSIDE] = IN_SPACE
    begin[INSIDE, IN_SPACE] = False
    step[BLANK] = AFTER_BLANK
    step[BREAK] = FRESH
    for left, then in ((ONE_LEFT, FRESH), (TWO_LEFT, ONE_LEFT)):
        step[:, left] = then
        begin[:, left] = False
    step[RESET] = FRESH  # before the first code point of a text
    begin[RESET] = True
    return step, begin


_STEP, _BEGIN = _rules()


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, product table, elements as functions of the state)."""
    ids = {tuple(range(STATES)): 0}
    for f in _STEP:
        ids.setdefault(tuple(f), len(ids))
    elements = list(ids)
    done = 0
    while done < len(elements):
        for f in _STEP:
            g = tuple(f[list(elements[done])])  # first the element, then the class
            if g not in ids:
                ids[g] = len(elements)
                elements.append(g)
        done += 1
    table = np.array(elements, np.uint8)
    product = np.array([[ids[tuple(b[list(a)])] for b in table] for a in elements], np.uint16)
    return np.array([ids[tuple(f)] for f in _STEP], np.uint16), product, table


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or INSIDE (white space) for every code point.

    The classes come once per worker from the tokenizer library itself, so that both know
    the same version of Unicode: what it finds of a property among all code points.
    """
    import tiktoken
    out = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([i]): i for i in range(256)}
    for kind, prop in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        of = tiktoken.Encoding("property", pat_str=prop, mergeable_ranks=single, special_tokens={})
        for low in range(0, 0x110000, 0x2000):  # all at once would take each worker 80 MB for a moment
            some = "".join(map(chr, range(low, low + 0x2000))) if not 0xD800 <= low < 0xE000 else ""
            found = of.decode(of.encode_ordinary(some))
            out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[list(WHITE_SPACE)] = INSIDE
    return out


def _scan(elements: np.ndarray) -> np.ndarray:
    """State before each position, starting FRESH: an associative scan over monoid elements."""
    _, product, table = _monoid()
    n = len(elements)
    blocks = -(-n // BLOCK)
    if blocks <= 1:
        state, out = FRESH, np.empty(n, np.uint8)
        for i, e in enumerate(elements.tolist()):
            out[i] = state
            state = table[e, state]
        return out
    padded = np.zeros(blocks * BLOCK, np.uint16)
    padded[:n] = elements
    grid = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    before = np.empty_like(grid)
    run = np.zeros(blocks, np.uint16)
    for i in range(BLOCK):
        before[i] = run
        run = product[run, grid[i]]
    entry = _scan(run)
    return table[before, entry[None, :]].T.reshape(-1)[:n]


def boundaries(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions where a match of the pattern begins; ``begins`` are the first positions of texts."""
    kinds = code_point_classes()[codes]
    n = len(codes)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    space = kinds == INSIDE
    follows = np.empty(n, bool)  # the next code point is of the same text and not white space
    follows[:-1] = ~space[1:]
    follows[first[1:]] = False
    last = space & follows
    kinds[last] = np.where(codes[last] == 0x20, BLANK, BREAK)
    for c in CONTRACTIONS:
        at = np.flatnonzero(codes[:n - len(c) + 1] == ord("'"))
        for j in range(1, len(c)):
            at = at[(codes[at + j] == ord(c[j])) & ~first[at + j]]
        kinds[at] = SHORT if len(c) == 2 else LONG
    elements, product, _ = _monoid()
    e = elements[kinds]
    own = np.flatnonzero(first[:n])
    e[own] = product[elements[RESET], e[own]]  # a text forgets what is to its left
    state = _scan(e)
    state[own] = FRESH
    return np.flatnonzero(_BEGIN[kinds, state])


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ranks of a piece after always joining the adjacent pair of lowest rank, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    if len(parts) > 200:
        return _merge_long(parts, ranks)
    get = ranks.get
    cost = [get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
    while cost:
        best = min(cost)
        if best == 1 << 30:
            break
        i = cost.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del cost[i]
        if i < len(cost):
            cost[i] = get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            cost[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
    return tuple(ranks[p] for p in parts)


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same for a very long piece: a heap of pairs over a linked list, n log n."""
    import heapq
    n = len(parts)
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1)
            if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or parts[i] + parts[j] != joined:
            continue
        parts[i], alive[j], after[i] = joined, False, after[j]
        if after[i] < n:
            prior[after[i]] = i
        for a in (prior[i], i):
            if a >= 0 and after[a] < n and (r := ranks.get(x := parts[a] + parts[after[a]])) is not None:
                heapq.heappush(heap, (r, a, x))
    return tuple(ranks[p] for p, ok in zip(parts, alive) if ok)


class Encoder:
    """Encodes texts by ranks; one per Python worker, with its own bounded cache."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int32)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        """Ids of a piece that the young generation of the cache lacks."""
        ids = self.older.get(piece) or array("i", merge(piece.encode("utf-8"), self.ranks)).tobytes()
        if len(piece) <= CACHE_BYTES_EACH:
            self.cache[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.cache) >= CACHE_PIECES:
            self.older, self.cache = self.cache, {}
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.int32) for _ in texts]
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        begins = np.unique(np.concatenate(([0], ends[:-1])))
        cut = boundaries(codes, begins[begins < len(codes)])
        per_text = np.searchsorted(cut, ends)
        cut = cut.tolist()
        pieces = [joined[a:b] for a, b in zip(cut, cut[1:] + [len(joined)])]
        get, make = self.cache.get, self._ids
        found = [get(p) or make(p) for p in pieces]
        out, a = [], 0
        for b in per_text.tolist():
            out.append(np.frombuffer(b"".join(found[a:b]), np.int32))
            a = b
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one line per token, base64 bytes and rank."""
    with open(path, "rb") as fh:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in fh if line.strip())}


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``GROUP_BYTES`` bytes, or one longer text."""
    a = size = 0
    for b, n in enumerate(sizes):
        if size and size + n > GROUP_BYTES:
            yield a, b
            a, size = b, 0
        size += n
    if a < len(sizes):
        yield a, len(sizes)


_ENCODERS: dict[int, Encoder] = {}


def encode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, offsets array<int>): ``offsets`` is the byte where each token starts.

    The rank file is read on the driver and broadcast (its size is that of the vocabulary).
    One output row per input row, in any order. A null or empty text gives empty arrays; a
    null id stays null; repeated rows are encoded each; other columns are ignored, and an
    empty table gives no rows. Very long texts are processed whole, one at a time.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value)
        enc = _ENCODERS[key]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).fill_null("")
            for a, b in _groups(pc.binary_length(texts).to_pylist()):
                tokens = enc.encode(texts[a:b].to_pylist())
                sizes = np.fromiter(map(len, tokens), np.int32, len(tokens))
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.concatenate(tokens)
                width = enc.sizes[flat].astype(np.int64)
                start = np.cumsum(width) - width
                start -= np.repeat(start[np.minimum(ends[:-1], max(0, len(flat) - 1))], sizes) if len(flat) else 0
                make = lambda v: pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32)))  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays([ids[a:b], make(flat), make(start)], ["id", "ids", "offsets"])
            del ids, texts
            pa.default_memory_pool().release_unused()

    t = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (src.mapInArrow(T.lean(run), f"id {t}, ids array<int>, offsets array<int>")
            .withColumnRenamed("id", id_col))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Replace ``ids`` by ``decoded`` (binary): the concatenated bytes of its tokens.

    All other columns pass through. Null ids decode to null, an empty array to no bytes;
    an id outside the vocabulary is an error.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rest = [c for c in df.columns if c != ids_col]
    src = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{ids_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        vocabulary = np.empty(max(ranks.values(), default=0) + 1, object)
        for token, i in ranks.items():
            vocabulary[i] = token
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a in range(0, batch.num_rows, 64):
                rows = column[a:a + 64]
                ends = np.concatenate(([0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy())))
                tokens = vocabulary[rows.flatten().to_numpy()].tolist()
                out = [b"".join(tokens[b:e]) if known else None for b, e, known in
                       zip(ends.tolist(), ends[1:].tolist(), rows.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i)[a:a + 64] for i in range(len(rest))] + [pa.array(out, pa.binary())],
                    [*(batch.schema.names[:len(rest)]), "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "decoded binary"])
    return src.mapInArrow(T.lean(run), schema)


def ranks_path() -> str:
    """Where this installation keeps the rank file used by the queries."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def digest_query(spark: SparkSession, documents: DataFrame, path: str) -> DataFrame:
    """Per document: number of tokens, digest of the ids, digest of the bytes decoded from them."""
    tokens = encode(documents, path)
    tokens = tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(
        F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    out = decode(tokens, path)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
