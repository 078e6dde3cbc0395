"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers cut the same bytes. A byte where tokens of both end is a cut, and the tokens
between two cuts form a group. All documents of a batch are merged in lockstep: one state
vector holds a pointer into each token sequence for every lane, a step moves the pointer whose token
ends first (both at a cut), records the cuts reached and drops the lanes that are through. A document is
one lane, or several where it is long: lanes begin at bytes where both tokenizers are known to end.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .storage import materialise

#: Tokens of a lane before the next known cut is looked for; pairs expanded at a time.
LANE_TOKENS, PAIRS = 128, 1 << 20
#: Pairs whose corpus counts are broadcast, the commonest ones; the others are joined.
FREQUENT = 1 << 20

OUTPUTS = {"a_ids": "array<int>", "b_ids": "array<int>", "a_cuts": "array<int>", "b_cuts": "array<int>",
           "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string",
           "pairs": "array<long>", "pair_links": "array<long>"}


# ------------------------------------------------------------------ merging
def lanes(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray,
          every: int = LANE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """First A and B token of each lane: those of the documents, and of every run of about ``every`` A
    tokens that ends where a B token ends too."""
    at = np.arange(every - 1, max(len(ends_a) - 1, 0), every)
    place = np.searchsorted(ends_b, ends_a[at])
    shared = ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a[at] if len(at) else np.zeros(0, bool)
    a = np.concatenate((first_a, at[shared] + 1))
    b = np.concatenate((first_b, place[shared] + 1))
    a, once = np.unique(a, return_index=True)
    return a, b[once]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts, as (A tokens, B tokens) before each, of token sequences that cover the same bytes.

    ``ends``: end of each token on one byte axis; ``first``: first token of each lane, ascending.
    """
    reached = np.zeros(len(ends_a) + 1, np.int64)  # B tokens before the cut after each A token
    stop = np.append(first_a[1:], len(ends_a))
    busy = stop > first_a
    a, b, stop = first_a[busy], first_b[busy], stop[busy]
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        cut = end_a == end_b
        reached[a[cut]] = b[cut]
        through = cut & (a == stop)
        if through.any():
            on = ~through
            a, b, stop = a[on], b[on], stop[on]
    a = np.flatnonzero(reached)
    return a, reached[a]


def linked(ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, docs: np.ndarray,
           width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct linked pairs of each document: (document, ``A id * width + B id``, links), sorted.

    Every A occurrence of a group is linked with every B occurrence of it. A group of very many links is
    counted from its distinct ids; links are expanded some at a time.
    """
    from_a, from_b = (np.concatenate(([0], cuts))[:-1] for cuts in (cuts_a, cuts_b))
    many_a, many_b = cuts_a - from_a, cuts_b - from_b
    size = many_a * many_b
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged(doc: np.ndarray, pair: np.ndarray, count: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((pair, doc))
        doc, pair = doc[order], pair[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(doc))) if count is None else np.add.reduceat(count[order], at) if len(at) else count
        return doc[at], pair[at], count

    large = size > PAIRS
    small = np.flatnonzero(~large)
    total = np.cumsum(size[small])
    bounds = np.unique(np.concatenate(([0], np.searchsorted(total, np.arange(PAIRS, (total[-1] if len(total) else 0) + PAIRS, PAIRS), "right"),
                                       [len(small)])))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        g = small[lo:hi]
        n = size[g]
        group = np.repeat(g, n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        row, column = np.divmod(k, many_b[group])
        parts.append(merged(docs[group], ids_a[from_a[group] + row] * width + ids_b[from_b[group] + column], None))
    for g in np.flatnonzero(large).tolist():
        a, na = np.unique(ids_a[from_a[g]:cuts_a[g]], return_counts=True)
        b, nb = np.unique(ids_b[from_b[g]:cuts_b[g]], return_counts=True)
        parts.append((np.full(len(a) * len(b), docs[g]), (a[:, None] * width + b).ravel(), (na[:, None] * nb).ravel()))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return parts[0] if len(parts) == 1 else merged(*(np.concatenate(x) for x in zip(*parts)))


# ------------------------------------------------------------- tokenizers
def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves, the
    others follow from U+0100 on (fixed rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Pair:
    """Two tokenizers: byte-level BPE of space + text, and word pieces that add the space."""

    def __init__(self, a_path: str, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else
                        self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # text of an id: first A token of a group, other A token, first B token, other B token
        forms = [(";", len(self.bytes_a)), (",", len(self.bytes_a)), ("|", len(self.bytes_b)), (",", len(self.bytes_b))]
        self.text_of = [f"{mark}{i}" for mark, n in forms for i in range(n)]
        self.forms = np.cumsum([0] + [n for _, n in forms])
        # tokens of A that begin with a space or a line end: in a run of pieces, the first of each piece
        self.first_a = np.zeros(len(self.bytes_a), bool)
        self.first_a[[i for i, t in enumerate(self.bytes_a) if t[:1] in (b" ", b"\n")]] = True
        # merges of B reach across a cut only if a piece of it holds a space after another letter, or a line end
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.cuttable = not any("▁" in p.lstrip("▁") or "\n" in p for p in names)
        self.kept = pieces.Kept(self._new, values=3)

    def _a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _b(self, texts: list[str]) -> list[list[int]]:
        """B ids of texts that begin with a space, which B adds, or with a line end, which it puts one before."""
        found = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1) if texts else []
        return [ids if t[0] == " " else ids[1:] for t, ids in zip(texts, found)]

    def _new(self, raw: list[bytes]) -> list[list]:
        """(A ids, B ids, [1] unless both spell the piece). What begins with its only white space is encoded by A
        side by side and split where a token begins with white space."""
        texts = [p.decode() for p in raw]
        plain = [t for t in texts if len(t) > 1 and not any(map(str.isspace, t[1:]))]
        ids = self._a(["".join(plain)])[0] if plain else []
        first = np.flatnonzero(self.first_a[np.array(ids, np.int64)]).tolist() if ids else []
        found = dict(zip(plain, (ids[a:b] for a, b in zip(first, [*first[1:], len(ids)])) if len(first) == len(plain) else self._a(plain)))
        other = [t for t in texts if t not in found]
        found |= dict(zip(other, self._a(other)))
        a, b = [found[t] for t in texts], self._b(texts)
        return [a, b, [[] if self._spells(p, x, y) else [1] for p, x, y in zip(raw, a, b)]]

    def _spells(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, number of them in each text, B ids, number of them): none where a text is empty or one of the
        tokenizers does not spell space + text."""
        raw = [b" " + t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
        cut = np.zeros(len(data), bool)
        if self.cuttable and len(data):
            # before a space or line end whose left neighbour is no white space, not even one beyond ASCII
            # (those end a character that begins with the bytes C2 or E1 to E3)
            cut[3:] = (np.isin(data[3:], (32, 10)) & (data[2:-1] > 32) & ((data[2:-1] < 128) | (data[1:-2] != 0xC2) & (
                (data[:-3] < 0xE1) | (data[:-3] > 0xE3))))
            cut[ends - 1] &= data[ends - 1] != 32  # B has no way to encode the last space alone
        cut[np.concatenate(([0], ends[:-1]))[:len(texts)]] = True
        starts = np.flatnonzero(cut)
        (a, n_a), (b, n_b), (_, odd) = self.kept(data, starts, np.append(starts[1:], len(data)))
        of = np.searchsorted(starts, np.concatenate(([0], ends)))
        per = lambda n: np.diff(np.concatenate(([0], np.cumsum(n)))[of])
        n_a, n_b, odd = per(n_a), per(n_b), per(odd)
        to_a, to_b = (np.concatenate(([0], np.cumsum(n))).tolist() for n in (n_a, n_b))
        none = np.array([not t for t in texts], bool)
        for i in np.flatnonzero(odd).tolist():
            none[i] |= not self._spells(raw[i], a[to_a[i]:to_a[i + 1]].tolist(), b[to_b[i]:to_b[i + 1]].tolist())
        if none.any():
            a, b = a[np.repeat(~none, n_a)], b[np.repeat(~none, n_b)]
            n_a, n_b = np.where(none, 0, n_a), np.where(none, 0, n_b)
        return a.astype(np.int64), n_a, b.astype(np.int64), n_b


class Aligned:
    """Token sequences of some texts and their cuts; every output is computed when it is asked for."""

    def __init__(self, pair: Pair, texts: list[str]) -> None:
        self.pair = pair
        self.a_ids, self.n_a, self.b_ids, self.n_b = pair.encode(texts)
        self.to_a, self.to_b = (np.concatenate(([0], np.cumsum(n))) for n in (self.n_a, self.n_b))
        ends_a, ends_b = np.cumsum(pair.size_a[self.a_ids]), np.cumsum(pair.size_b[self.b_ids])
        full = self.n_a > 0
        self.cuts_a, self.cuts_b = lockstep(ends_a, ends_b, *lanes(ends_a, ends_b, self.to_a[:-1][full], self.to_b[:-1][full]))
        self.to_cut = np.searchsorted(self.cuts_a, self.to_a, "right")
        self.docs = np.repeat(np.arange(len(texts)), np.diff(self.to_cut))

    def _pairs(self) -> tuple[pa.Array, pa.Array]:
        docs, pair, links = linked(self.a_ids, self.b_ids, self.cuts_a, self.cuts_b, self.docs, len(self.pair.bytes_b))
        ends = np.searchsorted(docs, np.arange(len(self.n_a) + 1))
        return tuple(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in (pair, links.astype(np.int64)))

    def _groups(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3``: ids of each group in order."""
        first_a, first_b = (np.concatenate(([0], cuts))[:-1] for cuts in (self.cuts_a, self.cuts_b))
        n, m = len(self.a_ids), len(self.b_ids)
        token = np.empty(n + m, np.int64)
        code_a, code_b = self.a_ids + self.pair.forms[1], self.b_ids + self.pair.forms[3]
        code_a[first_a], code_b[first_b] = self.a_ids[first_a], self.b_ids[first_b] + self.pair.forms[2]
        token[np.arange(n) + np.repeat(first_b, self.cuts_a - first_a)] = code_a
        token[np.arange(m) + np.repeat(self.cuts_a, self.cuts_b - first_b)] = code_b
        words = list(map(self.pair.text_of.__getitem__, token.tolist()))
        ends = (self.to_a + self.to_b).tolist()
        return pa.array(["".join(words[x:y])[1:] for x, y in zip(ends, ends[1:])], pa.string())

    def column(self, name: str) -> pa.Array:
        listed = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))
        if name in ("a_ids", "b_ids"):
            return listed(getattr(self, name), self.to_a if name[0] == "a" else self.to_b)
        if name in ("a_cuts", "b_cuts"):
            cuts, ends = (self.cuts_a, self.to_a) if name[0] == "a" else (self.cuts_b, self.to_b)
            return listed(cuts - np.repeat(ends[:-1], np.diff(self.to_cut)), self.to_cut)
        if name in ("n_a", "n_b"):
            return pa.array(getattr(self, name))
        if name == "n_groups":
            return pa.array(np.diff(self.to_cut))
        if name == "n_links":
            size = np.diff(self.cuts_a, prepend=0) * np.diff(self.cuts_b, prepend=0)
            return pa.array(np.diff(np.concatenate(([0], np.cumsum(size)))[self.to_cut]))
        return self._groups()


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


# -------------------------------------------------------------- operators
def align(df: DataFrame, a_path: str, b_path: str, outputs: tuple[str, ...] = ("a_ids", "b_ids", "a_cuts", "b_cuts"),
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and the ``outputs`` asked for (only those are computed):

    ``a_ids``, ``b_ids``: token ids; ``a_cuts``, ``b_cuts``: tokens before each cut, so group g holds A tokens
    ``a_cuts[g-1]`` to ``a_cuts[g]``; ``n_a``, ``n_b``, ``n_groups``, ``n_links``: their numbers; ``groups``: the groups as text;
    ``pairs`` and ``pair_links``: distinct linked ids, ``A id * size of B's vocabulary + B id``, and links of each.

    A null or empty text, and one that a tokenizer does not spell byte for byte, has no tokens: empty
    lists, zeros and ''. A null id stays null, repeated rows are aligned each, an empty table gives no rows, other
    columns are ignored. Texts are taken whole, a few at a time, a very long one alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).fill_null("")
            for x, y in pieces.groups(pc.binary_length(texts).to_pylist()):
                found = Aligned(pair, texts[x:y].to_pylist())
                listed = dict(zip(("pairs", "pair_links"), found._pairs())) if {"pairs", "pair_links"} & set(outputs) else {}
                yield pa.RecordBatch.from_arrays([ids[x:y], *(listed[o] if o in listed else found.column(o) for o in outputs)],
                                                 ["id", *outputs])
            del ids, texts
            pa.default_memory_pool().release_unused()

    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return (src.mapInArrow(run, ", ".join([f"id {kind}", *(f"{o} {OUTPUTS[o]}" for o in outputs)]))
            .withColumnRenamed("id", id_col))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``n``: how many rows hold each linked pair; counted before and after the shuffle."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def link_scores(aligned: DataFrame, width: int, frequent: int = FREQUENT) -> DataFrame:
    """Add ``n_best`` (links whose pair is in more rows than any other pair of its A id, ties included) and
    ``count_sum`` (rows that hold the pair, summed over links) to rows with ``pairs`` and ``pair_links``.

    The counts of the commonest pairs, at most ``frequent``, are broadcast; the bound is on numbers, so it is
    the same at every size. The other pairs are joined: those are in few rows each, so no key is hot.
    Rows without pairs get zeros; other columns pass through.
    """
    spark = aligned.sparkSession
    counts = pair_counts(aligned)
    best = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("top"))
    counts = materialise(counts.withColumn("a", F.expr(f"pair div {width}")).join(best, "a")
                         .select("pair", "n", (F.col("n") == F.col("top")).alias("is_best")), "pair-counts")
    # smallest power of two such that no more than `frequent` pairs are in as many rows
    level = F.floor(F.log2("n")).cast("int")
    least, held = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("m")).collect(), reverse=True):
        held += r.m
        if held > frequent:
            least = 2 ** (r.level + 1)
            break
    common = counts.where(F.col("n") >= least).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("pair", "n", "is_best")))
    del common
    keep = [c for c in aligned.columns if c not in ("pairs", "pair_links")]
    place = {c: f"_{i}" for i, c in enumerate(keep)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            for x in range(0, batch.num_rows, 64):
                rows = batch.slice(x, 64)
                listed, links = rows.column(len(keep)), rows.column(len(keep) + 1)
                of = np.repeat(np.arange(rows.num_rows), listed.value_lengths().fill_null(0).to_numpy())
                want, many = listed.flatten().to_numpy(), links.flatten().to_numpy()
                at = np.minimum(np.searchsorted(pair, want), max(len(pair) - 1, 0))
                hit = pair[at] == want if len(pair) else np.zeros(len(want), bool)
                total, tops = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
                np.add.at(total, of[hit], many[hit] * n[at[hit]])
                np.add.at(tops, of[hit], many[hit] * best[at[hit]])
                miss = ~hit
                ends = np.searchsorted(of[miss], np.arange(rows.num_rows + 1)).astype(np.int32)
                rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[miss])) for v in (want, many)]
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), pa.array(tops), pa.array(total), *rest],
                                                 [*place.values(), "tops", "total", "pairs", "links"])

    schema = ", ".join([*(f"{place[c]} {aligned.schema[c].dataType.simpleString()}" for c in keep),
                        "tops long, total long, pairs array<long>, links array<long>"])
    named = [F.col(v).alias(c) for c, v in place.items()]
    part = (aligned.select(*[F.col(f"`{c}`").alias(v) for c, v in place.items()], "pairs", "pair_links").mapInArrow(run, schema))
    if not least:
        return part.select(*named, F.col("tops").alias("n_best"), F.col("total").alias("count_sum"))
    part = materialise(part.withColumn("row", F.monotonically_increasing_id()), "pair-scores")
    rare = counts.where(F.col("n") < least)
    more = (part.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", "x.pairs", "x.links")
            .join(rare, F.col("pairs") == F.col("pair"))
            .groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("more_tops"),
                                F.sum(F.col("links") * F.col("n")).alias("more")))
    zero = F.lit(0).cast("long")
    return (part.drop("pairs", "links").join(more, "row", "left")
            .select(*named, (F.col("tops") + F.coalesce("more_tops", zero)).alias("n_best"),
                    (F.col("total") + F.coalesce("more", zero)).alias("count_sum")))


def paths() -> tuple[str, str]:
    """Where this installation keeps the two tokenizers of the query."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def vocabulary_size(b_path: str) -> int:
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=b_path).get_piece_size()


def alignment_query(documents: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT) -> DataFrame:
    """Per document the numbers of tokens, groups and links, scores of its links over the corpus, digest of the groups."""
    aligned = align(documents, a_path, b_path, ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pair_links"))
    aligned = aligned.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    aligned = materialise(aligned, "aligned")
    out = link_scores(aligned, vocabulary_size(b_path), frequent)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
