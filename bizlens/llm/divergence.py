"""Source divergence audit: how the words of each source of a language differ from the others'.

A worker turns a text into words with one ``bytes.translate`` (A-Z to a-z, every other ASCII character to
a space) and one ``bytes.split``; a Counter per document gives its terms. Terms are summed in the worker and then
over the shuffle per (language, source, term); only terms that occur are ever rows. What absent terms add to a
comparison follows from the groups' totals, so it is sparse throughout:

with f(p, q) = floor((p - q)^2 / (p + q)) over the V kept terms of a language, and p0, q0 the shares of a term
that is absent, the sum for groups g and h is

    sum over terms of both   of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
  + sum over terms of g      of f(p, q0)     (by distinct count: terms of one count have one share)
  + sum over terms of h      of f(p0, q)     (the same)
  + (V - terms of g - terms of h) * f(p0, q0)

All arithmetic is exact, in integers and decimals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Fixed values of the audit: least documents of a kept term, parts a share is counted in, terms reported of a group.
LEAST_DOCS, PARTS, TOP_TERMS = 10, 1_000_000_000, 10
#: Terms a worker sums before it hands them on, and bytes they may take.
HELD_TERMS, HELD_BYTES = 200_000, 32 << 20

#: Letters and all bytes beyond ASCII are kept, A-Z as a-z; every other byte is a separator (fixed values).
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Counter:
    """Counts of the terms of one UTF-8 text."""
    return Counter(text.translate(_TABLE).split())


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents), summed over some documents; a row with a null term for each
    (lang, source), so that groups without a term are known."""
    held: dict[tuple, dict] = {}
    n = size = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), of in held.items():
            names = list(of)
            for a in range(0, len(names), 20_000):
                some = names[a:a + 20_000]
                counts = [of[t] for t in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                     pa.array(some, pa.binary()).cast(pa.string()), pa.array([c[0] for c in counts], pa.int64()),
                     pa.array([c[1] for c in counts], pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            of = held.setdefault((lang, source), {None: [0, 0]})
            of[None][1] += 1
            for term, count in terms(text.as_py() or b"").items():
                if (known := of.get(term)) is None:
                    of[term] = [count, 1]
                    n, size = n + 1, size + len(term)
                else:
                    known[0] += count
                    known[1] += 1
            if n >= HELD_TERMS or size >= HELD_BYTES:
                yield from emit()
                held, n, size = {}, 0, 0
    yield from emit()


def term_counts(df: DataFrame, least_docs: int = LEAST_DOCS, lang_col: str = "lang", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """(lang, source, term, n): occurrences of each term that at least ``least_docs`` documents of the language
    have, where it occurs, and a row with a null term and the number of documents for each (lang, source).

    Null text, language or source counts as ''; an empty or wordless text adds no term but its group; repeated
    rows count each. Texts are taken whole. An empty table gives no rows; other columns are ignored.
    """
    src = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    sums = (src.mapInArrow(_sums, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    of_lang = Window.partitionBy("lang", "term")  # a row per source of the language
    return (sums.withColumn("all_docs", F.sum("docs").over(of_lang)).withColumn("lang_n", F.sum("n").over(of_lang))
            .where(F.col("term").isNull() | (F.col("all_docs") >= least_docs)).select("lang", "source", "term", "n", "lang_n"))


def _share(n: str, total: str) -> Column:
    """1 + floor(PARTS * (n + 2) / (total + 2 V)), exact beyond 64 bits; null without kept terms."""
    return F.expr(f"(cast({n} AS decimal(20,0)) + 2) * cast({PARTS} AS decimal(11,0)) "
                  f"div nullif(cast({total} AS decimal(20,0)) + 2 * cast(v AS decimal(17,0)), 0) + 1")


def _f(p: str, q: str) -> Column:
    """Shares are at most PARTS + 1, so squares fit 64 bits."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def shares(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``term_counts``: (groups, terms).

    groups: lang, source, ``total`` (occurrences of kept terms), ``k`` (kept terms that occur), ``v`` (kept terms of the
    language), ``lang_total`` and ``p0``, the share of an absent term (null if v is 0). terms: lang, source, term, ``p``
    the share in the group, ``q`` in the language, and the group's ``p0``.
    """
    kept = counts.where(F.col("term").isNotNull())
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    whole = (kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n"))
             .groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("v")))
    zero = F.lit(0).cast("long")
    groups = (counts.where(F.col("term").isNull()).select("lang", "source")
              .join(own, ["lang", "source"], "left").join(whole, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "k", "v", "lang_total")])
              .withColumn("p0", _share("0", "total")))
    groups = materialise(groups, "divergence-groups")
    terms_ = (kept.join(groups, ["lang", "source"])
              .select("lang", "source", "term", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"), "p0"))
    return groups, terms_


def source_pairs(groups: DataFrame, terms_: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum of f over all kept terms for every ordered pair of sources of a language,
    0 where the language keeps no term. Its rows are the pairs that the report lists; a term meets only the sources
    that have it, and the sums are begun before the shuffle."""
    x = terms_.select("lang", "term", "source", "p", "p0")
    y = terms_.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = (x.join(y, ["lang", "term"]).where("source < item")
            .groupBy("lang", "source", "item").agg(F.sum(_f("p", "q") - _f("p", "q0") - _f("p0", "q") + _f("p0", "q0")).alias("value")))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("k").alias("other_k"))
    one = (terms_.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
           .join(others, "lang").where("source <> item")
           .groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _f("p", "q0")).alias("value")))
    rest = (groups.join(others, "lang").where("source <> item")
            .select("lang", "source", "item", F.coalesce((F.col("v") - F.col("k") - F.col("other_k")) * _f("p0", "q0"),
                                                         F.lit(0).cast("long")).alias("value")))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return (both.unionByName(turned(both)).unionByName(one).unionByName(turned(one)).unionByName(rest)
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


def overused_terms(terms_: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group uses more than its language, by f, the first ``top``."""
    over = terms_.where("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
    return _ranked(over).where(F.col("rank") <= top)


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))).cast("int"))


def audit(df: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, lang_col: str = "lang",
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, every other source of the language by its divergence;
    part ``term``, the group's overused terms. Ranks begin at 1 in each group and part; equal values stand in
    ascending order of the item's bytes. Nulls, empty tables and repeated rows as in ``term_counts``; a language of
    one source has no pairs, one without kept terms pairs of value 0 and no terms."""
    counts = materialise(term_counts(df, least_docs, lang_col, source_col, text_col), "term-counts")
    groups, terms_ = shares(counts)
    terms_ = materialise(terms_, "term-shares")
    pairs = _ranked(source_pairs(groups, terms_)).withColumn("part", F.lit("pair"))
    over = overused_terms(terms_, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(over).select("lang", "source", "part", "item", "value", "rank")
