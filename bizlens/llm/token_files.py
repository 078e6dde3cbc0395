"""Token ids in binary files of patched frame-of-reference blocks.

Layout of a file, integers little-endian (fixed values):

* head: ``TOKF``, version, ids per block;
* blocks, one after another: count (u32), minimum (u32), width (u8), number of
  exceptions (u32), the exceptions' positions (u32 each) and offsets from the minimum
  (u32 each), then the low ``width`` bits of every offset from the minimum, packed. The width
  is the smallest that holds ``PERCENTILE`` of the block's offsets; the others are exceptions;
* where each block starts (u64 each);
* the documents: ids (i64 each), null flags (u8 each), numbers of ids (u64 each);
* foot: number of blocks, of documents and of ids (u64 each), where the block
  starts begin (u64), ``TOKF``.

A writer task streams its range of documents into files of its own, named anew at each
attempt, and returns a row per finished file. Only the rows of attempts that Spark accepts reach the
list of files, so what a lost or repeated task wrote is never read. Files stand in
order of their ranges; where a file begins among all ids follows from the counts in the list.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.session import checkpoint_dir

from . import pieces
from .storage import materialise

MAGIC, VERSION = b"TOKF", 1
HEAD, FOOT, BLOCK = struct.Struct("<4sII"), struct.Struct("<QQQQ4s"), struct.Struct("<IIBI")
#: Ids of a block, share of a block's ids that its width must hold, ids after which a file is closed.
BLOCK_IDS, PERCENTILE, FILE_IDS = 4096, 0.9, 1 << 25
#: Blocks read in one request; ids that a reader hands on at a time.
READ_BLOCKS, READ_IDS = 64, 1 << 18
#: The id after each document (fixed value).
END_ID = 2


# ----------------------------------------------------------------- blocks
def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at least one id (unsigned 32-bit)."""
    low = ids.min()
    offsets = (ids - low).astype("<u4")
    bits = np.frexp(offsets.astype(np.float64))[1]  # bit lengths: exact, 32-bit integers fit a double
    width = int(np.searchsorted(np.cumsum(np.bincount(bits, minlength=33)), percentile * len(ids)))
    odd = np.flatnonzero(bits > width).astype("<u4")
    packed = np.packbits(np.unpackbits(offsets.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width],
                         bitorder="little") if width else np.zeros(0, np.uint8)
    return (BLOCK.pack(len(ids), int(low), width, len(odd)) + odd.tobytes() + offsets[odd].tobytes() + packed.tobytes())


def unpack_block(data: memoryview | bytes, at: int = 0) -> np.ndarray:
    """Ids (uint32) of the block that starts at byte ``at``."""
    n, low, width, n_odd = BLOCK.unpack_from(data, at)
    at += BLOCK.size
    odd = np.frombuffer(data, "<u4", n_odd, at)
    exact = np.frombuffer(data, "<u4", n_odd, at + 4 * n_odd)
    at += 8 * n_odd
    wide = np.zeros((n, 32), np.uint8)
    if width:
        packed = np.frombuffer(data, np.uint8, (n * width + 7) // 8, at)
        wide[:, :width] = np.unpackbits(packed, count=n * width, bitorder="little").reshape(n, width)
    offsets = np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4").copy()
    offsets[odd] = exact
    return offsets + np.uint32(low)


# ------------------------------------------------------------------ files
def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a folder's address names, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", path))


class Writer:
    """One file: documents in, blocks out as they fill; keeps block starts and a few numbers a document."""

    def __init__(self, folder: str, name: str, percentile: float = PERCENTILE, block_ids: int = BLOCK_IDS) -> None:
        self.path, self.percentile, self.block_ids = f"{folder.rstrip('/')}/{name}", percentile, block_ids
        system, path = file_system(self.path)
        self.out = system.open_output_stream(path)
        self.starts, self.docs, self.counts, self.rest, self.n_ids = [], [], [], np.zeros(0, np.uint32), 0
        self.out.write(HEAD.pack(MAGIC, VERSION, block_ids))
        self.size = HEAD.size

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> None:
        """Documents in order, with the ids of all of them."""
        self.docs += doc_ids
        self.counts += counts
        self.n_ids += len(ids)
        ids = np.concatenate((self.rest, ids)) if len(self.rest) else ids
        whole = len(ids) - len(ids) % self.block_ids
        for a in range(0, whole, self.block_ids):
            self.starts.append(self.size)
            self._put(pack_block(ids[a:a + self.block_ids], self.percentile))
        self.rest = ids[whole:].copy()

    def close(self) -> int:
        """Write the last block and the tables; the file's size in bytes."""
        if len(self.rest):
            self.starts.append(self.size)
            self._put(pack_block(self.rest, self.percentile))
        at = self.size
        self._put(np.array([*self.starts, at], "<u8").tobytes())
        self._put(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self._put(np.array([d is None for d in self.docs], np.uint8).tobytes())
        self._put(np.array(self.counts, "<u8").tobytes())
        self._put(FOOT.pack(len(self.starts), len(self.docs), self.n_ids, at, MAGIC))
        self.out.close()
        return self.size


class Reader:
    """Random and sequential access to one file by its tables."""

    def __init__(self, path: str) -> None:
        system, inner = file_system(path)
        self.file = system.open_input_file(inner)
        magic, version, self.block_ids = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        size = self.file.size()
        blocks, docs, self.n_ids, at, last = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or last != MAGIC or version != VERSION:
            raise ValueError(f"{path} is not a token file of version {VERSION}")
        tables = self.file.read_at(size - FOOT.size - at, at)
        self.starts = np.frombuffer(tables, "<u8", blocks + 1).astype(np.int64)
        place = 8 * (blocks + 1)
        self.docs, null = np.frombuffer(tables, "<i8", docs, place), np.frombuffer(tables, np.uint8, docs, place + 8 * docs)
        self.null = null.astype(bool)
        self.counts = np.frombuffer(tables, "<u8", docs, place + 9 * docs).astype(np.int64)

    def close(self) -> None:
        self.file.close()

    def blocks(self, first: int, last: int) -> Iterator[np.ndarray]:
        """Ids of the blocks first to last - 1, some blocks a request."""
        for a in range(first, last, READ_BLOCKS):
            b = min(last, a + READ_BLOCKS)
            data = self.file.read_at(int(self.starts[b] - self.starts[a]), int(self.starts[a]))
            for at in (self.starts[a:b] - self.starts[a]).tolist():
                yield unpack_block(data, at)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start`` of the file: only the blocks that hold them are read."""
        first, last = start // self.block_ids, -(-(start + count) // self.block_ids)
        found = list(self.blocks(first, min(last, len(self.starts) - 1))) if count else []
        return np.concatenate([np.zeros(0, np.uint32), *found])[start - first * self.block_ids:][:count]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, last + 1, ids of them): runs of about ``READ_IDS`` ids, or one longer document."""
        ends = np.cumsum(self.counts)
        blocks, held, rest = self.blocks(0, len(self.starts) - 1), 0, np.zeros(0, np.uint32)
        a = done = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, done + READ_IDS, "right")))
            want, got, held = int(ends[b - 1]) - done, [rest], len(rest)
            while held < want:
                got.append(next(blocks))
                held += len(got[-1])
            got = np.concatenate(got)
            yield a, b, got[:want]
            rest, a, done = got[want:], b, int(ends[b - 1])


# -------------------------------------------------------------- operators
#: White space, which the tokenizer drops, and marks that no word of letters shares a token with.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_MARK = np.isin(np.arange(256), [44, 46])


class Words:
    """Ids of a tokenizer that drops white space, lowers letters and cuts words from marks, word by word."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept = pieces.Kept(self._new)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _new(self, words: list[bytes]) -> list[list]:
        """New words: those of letters alone are encoded side by side and split at the ends of words."""
        texts = [w.decode() for w in words]
        plain = [t for t in texts if t.isalpha()]
        ids = self._encode([" ".join(plain)])[0] if plain else []
        cuts = (np.flatnonzero(self.ends[np.array(ids, np.int64)]) + 1).tolist() if ids else []
        if len(cuts) == len(plain):  # every word has one end: none was split further
            found = dict(zip(plain, (ids[a:b] for a, b in zip([0, *cuts], cuts))))
        else:
            found = dict(zip(plain, self._encode(plain)))
        other = [t for t in texts if t not in found]
        found |= dict(zip(other, self._encode(other)))
        return [[found[t] for t in texts]]

    def __call__(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        # the case of a special token counts: such texts keep theirs
        data = np.frombuffer(b"".join([t if b"<|" in t else t.translate(_LOWERED) for t in raw]), np.uint8)
        ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
        inside = np.concatenate(([False], ~_SPACE[data], [False]))
        after, before = data[1:], data[:-1]
        cut = _MARK[after] & _LETTER[before] | _LETTER[after] & _MARK[before]
        at = ends[:-1]
        cut[at[(at > 0) & (at < len(data))] - 1] = True
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        first[1:] |= cut & inside[2:-1]
        last[:-1] |= cut & inside[1:-2]
        starts = np.flatnonzero(first)
        ids, many = self.kept(data, starts, np.flatnonzero(last) + 1)[0]
        total = np.concatenate(([0], np.cumsum(many)))
        return ids, np.diff(total[np.searchsorted(starts, np.concatenate(([0], ends)))])


_LOWERED = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORDS: dict[str, Words] = {}


def _tokenizer(path: str) -> Words:
    if path not in _WORDS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _WORDS[path] = Words(path)
    return _WORDS[path]


FILES = ("part int, number int, path string, bytes long, n_docs long, n_ids long, first_doc long, last_doc long")


def write(df: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode whole texts, write the ids of each document and ``end_id`` to files below ``folder`` in order of
    ``id_col``, and return the list of files: ``part`` and ``number`` (their order), ``path``, sizes, ``start``
    (ids in all files before it) and the first and last id.

    Documents are range-partitioned and sorted by id; equal ids follow by a hash of the text, and
    rows equal in both in any order, dealt over the ranges like other rows. A null id comes first and
    stays null; a null or empty text gives ``end_id`` alone. An empty table gives an empty list;
    other columns are ignored, whatever their names. A document is never split over files, so a very long one
    makes one larger file; only a few blocks and texts are in memory at a time.
    """
    folder = folder.rstrip("/")
    system, inner = file_system(folder)
    system.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _tokenizer(tokenizer_path), TaskContext.get().partitionId()
        writer, number, rows = None, 0, []

        def finish() -> None:
            size = writer.close()
            rows.append((part, number, writer.path, size, len(writer.docs), writer.n_ids, writer.docs[0], writer.docs[-1]))

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).fill_null(b"")
            for a, b in pieces.groups(pc.binary_length(texts).to_pylist(), min(pieces.GROUP_BYTES, file_ids)):
                coded, counts = encode(texts[a:b].to_pylist())
                counts = counts + 1
                closed = np.full(int(counts.sum()), end_id, np.uint32)
                own = np.ones(len(closed), bool)
                own[np.cumsum(counts) - 1] = False
                closed[own] = coded
                if writer is None:
                    writer = Writer(folder, f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.tok", block_ids=block_ids)
                writer.add(ids[a:b].to_pylist(), counts.tolist(), closed)
                if writer.n_ids >= file_ids:
                    finish()
                    writer, number = None, number + 1
            del ids, texts
            pa.default_memory_pool().release_unused()
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()),
                        ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())])
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
                    F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    files = materialise(src.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
                        .mapInArrow(run, FILES), "token-files")
    # a number per range reaches the driver, as many as there are tasks
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before = dict(zip([r.part for r in totals], np.cumsum([0, *(r.n for r in totals)]).tolist()))
    starts = df.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    earlier = F.expr("sum(n_ids) OVER (PARTITION BY part ORDER BY number) - n_ids")
    return (files.withColumn("earlier", earlier).join(starts, "part")
            .withColumn("start", F.col("before") + F.col("earlier")).drop("before", "earlier"))


def read(files: DataFrame, as_bytes: bool = False) -> DataFrame:
    """Documents of the listed files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids``, an array<long>, or with ``as_bytes`` their little-endian 32-bit integers as binary.

    Files are dealt over the tasks and streamed, some blocks at a time. An empty list gives no rows; a
    missing or damaged file is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                reader = Reader(path)
                for a, b, ids in reader.documents():
                    counts = reader.counts[a:b]
                    ends = np.concatenate(([0], np.cumsum(counts)))
                    if as_bytes:
                        column = pa.Array.from_buffers(pa.large_binary(), b - a, [
                            None, pa.py_buffer(4 * ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                    else:
                        column = pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.docs[a:b], mask=reader.null[a:b]), pa.array(start + ends[:-1].astype(np.int64)),
                         pa.array(counts), column], ["doc_id", "start", "n_tokens", "ids"])
                    start += int(counts.sum())
                reader.close()

    # one task a file: a file is large, a row of the list is not
    n = min(max(1, files.count()), 100_000)
    dealt = files.select("path", "start").repartition(n, F.xxhash64("path"))
    return dealt.mapInArrow(run, f"doc_id long, start long, n_tokens long, ids {'binary' if as_bytes else 'array<long>'}")


def tokenizer_path() -> str:
    """Where this installation keeps the tokenizer used by the query."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(spark: SparkSession, documents: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write all documents as token files in the shared folder and digest what is read back from them."""
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    back = read(write(documents, path, folder), as_bytes=True)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
