"""Feature preparation (ML1-ML4, ML7)."""

from __future__ import annotations

from pyspark.ml.feature import PCA, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.operators.scan import row_index
from bizlens.session import reliable


def _cols(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def column_slice(df: DataFrame, start: int | None, stop: int | None = None) -> DataFrame:
    """PJ7: the columns from position ``start`` up to, not including, ``stop``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[start:stop]])


def align(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """JN7: put the columns of two frames side by side on a key that is unique in ``right``."""
    return left.join(right, key, how)


#: Levels that ``one_hot`` makes a column each of; ``one_hot_vector`` takes any number.
MAX_COLUMNS = 10_000


def category_levels(df: DataFrame, columns, max_levels: int = MAX_COLUMNS) -> dict[str, list[str]]:
    """Distinct string values of each column, found in one job.

    The level list is the width of an encoded frame and so reaches the driver: a column of more than
    ``max_levels`` is refused, and no more than that many levels a column are collected.
    """
    cols = _cols(columns)
    rows = _levels(df, cols).limit(max_levels * len(cols) + 1).collect()
    levels: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        levels[cols[r["column"]]].append(r["level"])
    for c, vs in levels.items():
        if len(vs) > max_levels or len(rows) > max_levels * len(cols):
            raise ValueError(f"column {c} has more than {max_levels} levels" if len(vs) > max_levels else
                             f"the columns have more than {max_levels} levels each")
        vs.sort()
    return levels


def _levels(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct (number of the column, level as text) of all columns, reduced before one shuffle."""
    return (df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("string").alias("level"))
                                          for i, c in enumerate(cols)])).alias("x"))
            .select("x.column", "x.level").where(F.col("level").isNotNull()).distinct())


def dictionary(df: DataFrame, columns) -> DataFrame:
    """(column, level, code): the levels of every column and their place in the order of their UTF-8 bytes, from 0.

    Levels are range-partitioned and counted a range at a time (``scan.row_index``), so any number of levels
    fits; all columns are numbered in one go. ``column`` is the position in ``columns``; null is no level.
    """
    cols = _cols(columns)
    numbered = row_index(_levels(df, cols), ["column", "level"], "code")
    first = numbered.groupBy("column").agg(F.min("code").alias("_first"))  # a row per column
    return reliable(numbered.join(F.broadcast(first), "column").select("column", "level", (F.col("code") - F.col("_first")).alias("code")))


def one_hot(df: DataFrame, columns, max_levels: int = MAX_COLUMNS, drop_source: bool = True,
            levels: dict[str, list[str]] | None = None) -> DataFrame:
    """ML1: one 0/1 column per level, named ``<column>_<level>``, levels in string order.

    Every level is kept (no reference level dropped); NULL gives all zeros. A name that is taken, by a
    column that stays or by another level, gets ``#2``, ``#3`` and so on. Columns of more than
    ``max_levels`` levels are refused; ``one_hot_vector`` encodes those.
    """
    cols = _cols(columns)
    levels = levels or category_levels(df, cols, max_levels)
    kept = [c for c in df.columns if not (drop_source and c in cols)]
    taken, new = {c.lower() for c in kept}, []
    for c in cols:
        x = F.col(f"`{c}`").cast("string")
        for v in levels[c]:
            name, n = f"{c}_{v}", 1
            while name.lower() in taken:
                n += 1
                name = f"{c}_{v}#{n}"
            taken.add(name.lower())
            new.append(F.when(x == v, F.lit(1)).otherwise(F.lit(0)).alias(name))
    return df.select(*[F.col(f"`{c}`") for c in kept], *new)


def one_hot_vector(df: DataFrame, columns, out_col: str = "features") -> DataFrame:
    """ML1 for any number of levels: all columns as one sparse 0/1 vector in ``out_col``, an existing one replaced.

    Places are those of ``dictionary``: the levels of the first column in order, then those of the second,
    and so on. Null gives no entry. The plan has a column per source column, not per level.
    """
    cols = _cols(columns)
    codes = dictionary(df, cols)
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = [f"__code_{i}" for i in range(len(cols))]
    coded = _coded(df, cols, codes, place)
    # a code past the last level stands for null; as the last category it is the one without an entry
    widths = [sizes.get(i, 0) for i in range(len(cols))]
    coded = coded.select("*", *[F.coalesce(F.col(p), F.lit(w)).cast("double").alias(f"{p}d") for p, w in zip(place, widths)])
    spark = df.sparkSession
    fitted = spark.createDataFrame([tuple(float(w) for w in widths)], ", ".join(f"{p}d double" for p in place))
    encoder = OneHotEncoder(inputCols=[f"{p}d" for p in place], outputCols=[f"{p}v" for p in place], dropLast=True).fit(fitted)
    out = VectorAssembler(inputCols=[f"{p}v" for p in place], outputCol="__vector").transform(encoder.transform(coded))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != out_col], F.col("__vector").alias(out_col))


def ones(vector) -> Column:
    """(width, places) of a 0/1 vector: its length and the places that are 1, ascending, read from the stored entries.

    A sparse vector of many levels is never written out as an array. Null gives null.
    """
    @F.udf("width int, places array<int>")
    def read(v):
        if v is None:
            return None
        at = v.indices[v.values == 1] if hasattr(v, "indices") else (v.toArray() == 1).nonzero()[0]
        return v.size if hasattr(v, "indices") else len(v), at.tolist()

    return read(F.col(vector) if isinstance(vector, str) else vector)


def _coded(df: DataFrame, cols: list[str], codes: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the code of every column beside it: a join per column, on its level; Spark broadcasts a small
    dictionary and splits a level of very many rows otherwise."""
    for i, (c, name) in enumerate(zip(cols, names)):
        own = codes.where(F.col("column") == i).select(F.col("level").alias(f"{name}l"), F.col("code").cast("int").alias(name))
        df = df.join(own, F.col(f"`{c}`").cast("string") == F.col(f"{name}l"), "left").drop(f"{name}l")
    return df


def label_encode(df: DataFrame, columns, suffix: str = "", max_levels: int | None = None) -> DataFrame:
    """ML2: codes 0..k-1 in the order of the string values' UTF-8 bytes; null stays null.

    The levels are a distributed dictionary that is joined back, so none of them reaches the driver, however
    many there are. A caller may set ``max_levels`` to have columns of more levels refused, by an exact count.
    Columns keep their places; with ``suffix`` the codes are added behind, or replace columns of that name.
    """
    cols = _cols(columns)
    codes = dictionary(df, cols)
    if max_levels is not None:
        for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_levels).collect():
            raise ValueError(f"column {cols[r['column']]} has {r['n']} levels (> {max_levels})")
    place = {c + suffix: f"__code_{i}" for i, c in enumerate(cols)}
    out = _coded(df, cols, codes, list(place.values()))
    old = [F.col(place[c]).alias(c) if c in place else F.col(f"`{c}`") for c in df.columns]
    return out.select(*old, *[F.col(p).alias(c) for c, p in place.items() if c not in df.columns])


def standardise(df: DataFrame, columns, digits: int | None = None, suffix: str = "") -> DataFrame:
    """ML3: ``(x - mean) / std`` with the population std; constant columns give 0.

    Fitting is one aggregation over all columns; its single row (two numbers
    per column, the scaler's parameters) is what reaches the driver, and the
    transform is a plain projection with literals.
    """
    cols = _cols(columns)
    x = [F.col(f"`{c}`") for c in cols]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    out = df
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if m is None or s is None or s == 0:
            z = F.when(x[i].isNotNull(), F.lit(0.0))
        else:
            z = (x[i] - F.lit(float(m))) / F.lit(float(s))
        if digits is not None:
            z = F.round(z, digits)
        out = out.withColumn(c + suffix, z)
    return out


def assemble(df: DataFrame, columns, out_col: str = "features") -> DataFrame:
    cols = _cols(columns)
    plain = [f"__x{i}" for i in range(len(cols))]  # a level may hold a dot
    named = df.select("*", *[F.col(f"`{c}`").alias(n) for c, n in zip(cols, plain)])
    return VectorAssembler(inputCols=plain, outputCol=out_col, handleInvalid="error").transform(named).drop(*plain)


def pca(df: DataFrame, features_col: str, k: int, prefix: str = "col"):
    """ML4: PCA of an (already centred) vector column.

    Returns ``(projected frame, explained-variance frame)``; the projection adds
    ``col1..colk``. The covariance is a distributed aggregate; only the d x d
    matrix reaches the driver.
    """
    model = PCA(k=k, inputCol=features_col, outputCol="_pca").fit(df)
    arr = vector_to_array("_pca")
    projected = (model.transform(df)
                 .select("*", *[arr[i].alias(f"{prefix}{i + 1}") for i in range(k)]).drop("_pca"))
    ratios = [float(v) for v in model.explainedVariance.toArray()]
    spark = df.sparkSession
    cum, rows = 0.0, []
    for i, r in enumerate(ratios):
        cum += r
        rows.append((i + 1, r, cum))
    variance = spark.createDataFrame(rows, "component int, ratio double, cumulative double")
    return projected, variance


def split_flag(key, test_fraction: float = 0.3, seed: int = 42, method: str = "hash") -> Column:
    """ML7: ``'test'``/``'train'`` from the row key (stable under repartitioning).

    ``method='hash'``: seeded xxhash64 of the key; ``'modulo'``: ``key % 10`` below
    ``10 * fraction`` (for integer keys with no pattern in their last digit).
    """
    k = F.col(key) if isinstance(key, str) else key
    if method == "hash":
        test = F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(10000)) < F.lit(int(round(test_fraction * 10000)))
    elif method == "modulo":
        test = F.pmod(k, F.lit(10)) < F.lit(int(round(test_fraction * 10)))
    else:
        raise ValueError(method)
    return F.when(test, F.lit("test")).otherwise(F.lit("train"))
