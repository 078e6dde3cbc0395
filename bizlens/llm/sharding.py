"""Shards of near-equal bytes by sampled splitters, with DataFrame functions only.

Rows are ordered by (group key, id). A sample weighted by size gives quantile splitters that
cut the order into many fine ranges; the ranges are counted exactly and overfull ones are
subdivided with further samples. Running sums inside a range plus the totals of the ranges
before it give every row its exact place in bytes, and the place decides the shard. Only
the splitters and the totals of the ranges pass the driver; there are about
``rows / ROWS_EACH`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .storage import materialise

#: Fine ranges: at least so many per shard, and one more for so many rows.
RANGES_EACH, ROWS_EACH = 32, 200_000
#: Sampled rows per range.
OVERSAMPLE = 8
#: A range with more than this many times the mean of rows or bytes is subdivided.
OVERFULL = 3
#: A group of more than this share of a shard's bytes may be cut between shards.
GROUP_SHARE = 0.01

_LOWEST = -(1 << 63)


def _rank(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below the row's (key, id): binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    keys = F.lit([k for k, _ in splitters]).cast("array<bigint>")
    ids = F.lit([i for _, i in splitters]).cast("array<bigint>")
    rounds = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s.lo + s.hi) / 2).cast("int")
        k, i = F.get(keys, mid), F.get(ids, mid)
        below = (k < F.col("key")) | ((k == F.col("key")) & (i <= F.col("id")))
        open_ = s.lo < s.hi
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s.lo).alias("lo"),
                        F.when(open_ & ~below, mid).otherwise(s.hi).alias("hi"))

    return F.aggregate(rounds, start, halve, lambda s: s.lo)


def _sampled(rows: DataFrame, per_byte: Column, seed: int) -> DataFrame:
    """(key, id) of rows drawn with a chance proportional to their size; the draw is a hash of the row."""
    u = F.pmod(F.xxhash64("key", "id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(u < F.col("size") * per_byte).select("key", "id")


def _splitters(rows: DataFrame, total: int, count: int, ranges: int, whole: set[int]) -> tuple[list, list]:
    """Composite splitters and the exact (rows, bytes) of the ranges between them."""
    def clean(points):  # only groups that may be cut are cut inside
        return {(k, i) if k in whole else (k, _LOWEST) for k, i in points}

    drawn = sorted((r.key, r.id) for r in _sampled(rows, F.lit(OVERSAMPLE * ranges / total), 0).collect())
    splitters = sorted(clean(drawn[OVERSAMPLE::OVERSAMPLE]))
    seed = 0
    while True:
        seed += 1
        placed = rows.withColumn("range", _rank(splitters))
        stats = {r.range: r for r in placed.groupBy("range").agg(
            F.count("*").alias("rows"), F.sum("size").alias("bytes"),
            F.min(F.struct("key", "id")).alias("low"), F.max(F.struct("key", "id")).alias("high")).collect()}
        full = {k: max(r.rows / (OVERFULL * max(1, count / ranges)), r.bytes / (OVERFULL * max(1, total / ranges)))
                for k, r in stats.items()}
        full = {k: v for k, v in full.items() if v > 1 and tuple(stats[k].low) < tuple(stats[k].high)}
        if full:
            rate = F.coalesce(*[F.when(F.col("range") == k, F.lit(OVERSAMPLE * 4 * v / stats[k].bytes))
                                for k, v in full.items()])
            chosen = placed.where(F.col("range").isin(list(full)))
            more = sorted((r.key, r.id) for r in _sampled(chosen, rate, seed).collect())
            grown = sorted(clean(more[OVERSAMPLE // 2::OVERSAMPLE]) | set(splitters))
            if len(grown) > len(splitters):
                splitters = grown
                continue
        return splitters, [(stats[k].rows, stats[k].bytes) if k in stats else (0, 0)
                           for k in range(len(splitters) + 1)]


def assign(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard (0 to shards - 1), slot (0, 1, ... in each shard).

    ``size`` is the text's UTF-8 bytes (null: none) plus 1; shard totals are near equal.
    Rows of equal texts stay in one shard unless their group holds more than ``GROUP_SHARE``
    of a shard, which is then cut where the bytes say so. Null texts are one group with null
    text_crc32; a null id sorts first and stays null; repeated rows are placed each; other
    columns are ignored, but ``carry`` names one that comes along as ``carried``; an empty table gives no rows.
    """
    text = F.col(text_col)
    more = [F.col(f"`{carry}`").alias("carried")] if carry else []
    along = ["carried"] if carry else []
    rows = materialise(df.select(*more,
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("id")), "rows")
    sums = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total, count = sums.bytes or 0, sums.rows
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), *along)
    # at most shards / GROUP_SHARE groups are this large
    limit = GROUP_SHARE * total / shards
    cut = {r.key for r in rows.groupBy("key").agg(F.sum("size").alias("b")).where(F.col("b") > limit).select("key").collect()}
    ranges = max(RANGES_EACH * shards, count // ROWS_EACH)
    splitters, stats = _splitters(rows, total, count, ranges, cut)
    before, r0, b0 = [], 0, 0
    for k, (r, b) in enumerate(stats):
        before.append((k, r0, b0))
        r0, b0 = r0 + r, b0 + b
    schema = Ty.StructType([Ty.StructField("range", Ty.IntegerType()), Ty.StructField("rows_before", Ty.LongType()),
                            Ty.StructField("bytes_before", Ty.LongType())])
    offsets = df.sparkSession.createDataFrame(before, schema)
    order = Window.partitionBy("range").orderBy("key", "id")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.withColumn("range", _rank(splitters)).join(F.broadcast(offsets), "range")
              .withColumn("at", F.col("bytes_before") + F.sum("size").over(running) - F.col("size"))
              .withColumn("rank", F.col("rows_before") + F.row_number().over(order) - 1)
              .withColumn("at", F.when(F.col("key").isin(list(cut)) if cut else F.lit(False), F.col("at"))
                          .otherwise(F.first("at").over(group))))
    placed = placed.withColumn("shard", F.least(F.expr(f"at * {shards} div {total}"), F.lit(shards - 1)).cast("int"))
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard", "rank", *along), "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # a row per shard
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"), *along))


def write(df: DataFrame, path: str, shards: int = 8) -> None:
    """Write every row of ``df`` (doc_id, text, ...) with its shard and slot, one folder per shard.

    Rows are matched by a number of their own, so rows without doc_id and repeated rows are written each. Input
    columns named ``shard`` or ``slot`` are written with ``_in`` behind their names. An empty table writes none.
    """
    taken = {c: f"{c}_in" for c in ("shard", "slot") if c in df.columns}
    rows = materialise(df.withColumnsRenamed(taken).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    places = assign(rows, shards, carry="__row").select(F.col("carried").alias("__row"), "shard", "slot")
    rows.join(places, "__row").drop("__row").write.partitionBy("shard").parquet(path)


def shards_query(documents: DataFrame, shards: int = 8) -> DataFrame:
    """All documents by the law ``bytes``."""
    return assign(documents, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
