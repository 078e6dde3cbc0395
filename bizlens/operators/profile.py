"""Profiling (PR1-PR7, AG3). Each profile is one aggregation job over the input,
except ``describe``, whose exact quartiles take a second scan."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from bizlens.functions.ratios import number, round_decimal
from bizlens.operators.quantiles import grouped_quantiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no installed package


def _cols(df: DataFrame, columns) -> list[str]:
    return list(df.columns) if columns is None else ([columns] if isinstance(columns, str) else list(columns))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def shape(df: DataFrame) -> DataFrame:
    """PJ8: one row with the row count and the column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    """PR1: one row, one column per input column holding its NULL count."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in _cols(df, columns)])


def distinct_counts(df: DataFrame, columns=None, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """AG3: distinct non-null values per column (exact by default)."""
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    return df.agg(*[fn(F.col(c)).alias(c) for c in _cols(df, columns)])


def schema_report(df: DataFrame, columns=None) -> DataFrame:
    """PR6: (column, type, non_null, nulls) per column, counted in one job."""
    cols = _cols(df, columns)
    types = dict(df.dtypes)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count(F.col(c)).alias(f"_nn_{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', '{types[c]}', _nn_{i}" for i, c in enumerate(cols))
    return counts.selectExpr(f"stack({len(cols)}, {stack}) AS (column, type, non_null)", "_rows") \
                 .select("column", "type", "non_null", (F.col("_rows") - F.col("non_null")).alias("nulls"))


def category_counts(df: DataFrame, columns, count_col: str = "n") -> DataFrame:
    """PR3: value frequencies of many columns in one job (unpivot, then one groupBy)."""
    cols = _cols(df, columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("_kv")).select("_kv.column", "_kv.value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias(count_col))


def describe(df: DataFrame, columns=None, digits: int | None = 6,
             method: str = "exact") -> DataFrame:
    """PR2: count, mean, std (sample), min, quartiles, max per numeric column, long form.
    NaN is missing, like NULL.

    Two scans of the input: the first finds the moments and a quantile sketch of every
    column, the second the exact quartiles (linear interpolation, as pandas ``describe``). With
    ``method='approx'`` quartiles come from ``percentile_approx`` in the same scan as the moments.
    """
    cols = _cols(df, columns) if columns is not None else numeric_columns(df)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), number(f"`{c}`").alias("value")) for c in cols
    ])).alias("_kv")).select("_kv.column", "_kv.value")
    probs, names = [0.25, 0.5, 0.75], ["q25", "q50", "q75"]
    moments = lambda x: (F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    if method == "approx":
        points = F.percentile_approx("value", probs, 10_000).alias("_q")
        out = long.groupBy("column").agg(F.count("value").alias("n"), *moments("value"), points)
        out = out.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    else:
        out = grouped_quantiles(long, "value", probs, ["column"], names, also=moments("_x"))
    out = out.withColumnRenamed("n", "count")
    if digits is not None:
        for c in ("mean", "std", "q25", "q50", "q75"):
            out = out.withColumn(c, round_decimal(c, digits))
    return out.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


#: A column whose variance is below this share of its mean square about the overall mean counts as constant.
CONSTANT = 1e-11


def correlation(df: DataFrame, columns=None, digits: int | None = 6) -> DataFrame:
    """PR5: Pearson correlation of every pair of numeric columns, long form.

    Pairwise-complete rows (both values present, NaN is missing); a column that is constant on them gives NULL instead of
    a division-by-zero error (D12), and so do pairs without rows. One aggregation finds the means; one more
    pass multiplies the centred values and the masks of present values (three matrix products a batch give counts, sums,
    squares and products of all pairs at once) and the tasks' sums are added up per pair.
    """
    cols = _cols(df, columns) if columns is not None else numeric_columns(df)
    x = df.select(*[number(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    means = x.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(cols))]).first()
    centre = np.array([means[i] or 0.0 for i in range(len(cols))])
    upper = np.triu_indices(len(cols))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(cols), len(cols)))
        s, q, p = n.copy(), n.copy(), n.copy()
        for batch in batches:
            present = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            values = np.stack([c.fill_null(0.0).to_numpy() for c in batch.columns], axis=1)
            values = np.where(present > 0, values - centre, 0.0)
            n += present.T @ present
            s += values.T @ present  # of the row's column where the other one is present
            q += (values * values).T @ present
            p += values.T @ values
        i, j = upper
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, (
            n[upper], s[upper], s.T[upper], q[upper], q.T[upper], p[upper]))], ["i", "j", "n", "si", "sj", "qi", "qj", "p"])

    sums = (x.mapInArrow(gram, "i int, j int, n double, si double, sj double, qi double, qj double, p double")
            .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "qi", "qj", "p")]))
    var = lambda q, s: F.col(q) - F.try_divide(F.col(s) * F.col(s), F.col("n"))
    varies = (var("qi", "si") > CONSTANT * F.col("qi")) & (var("qj", "sj") > CONSTANT * F.col("qj"))
    r = F.when(varies, (F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / F.sqrt(var("qi", "si") * var("qj", "sj")))
    r = F.when(F.col("i") == F.col("j"), F.when(varies, F.lit(1.0))).otherwise(r)
    if digits is not None:
        r = round_decimal(r, digits)
    names = F.array(*[F.lit(c) for c in cols])
    half = sums.select("i", "j", r.alias("corr"))
    both = half.unionByName(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    return both.select(F.get(names, "i").alias("column_a"), F.get(names, "j").alias("column_b"), "corr")


def quality_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """PR7: evaluate data-quality rules in one job -> (rule, column, checked, failed).

    Rule kinds: ``unique`` (duplicated non-null keys), ``range`` (outside
    ``[lo, hi]``), ``allowed`` (not in ``values``), ``not_null``.
    """
    aggs, meta = [], []
    for k, r in enumerate(rules):
        c = F.col(r["column"])
        kind = r["kind"]
        if kind == "unique":
            failed = F.count(c) - F.count_distinct(c)
            checked = F.count(c)
        elif kind == "range":
            failed = F.count_if(~c.between(r["lo"], r["hi"]))
            checked = F.count(c)
        elif kind == "allowed":
            failed = F.count_if(~c.isin(list(r["values"])))
            checked = F.count(c)
        elif kind == "not_null":
            failed = F.count_if(c.isNull())
            checked = F.count(F.lit(1))
        else:
            raise ValueError(f"unknown rule kind {kind}")
        aggs += [checked.alias(f"_k{k}"), failed.alias(f"_f{k}")]
        meta.append((r.get("name", f"{kind}:{r['column']}"), r["column"]))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(n).alias("rule"), F.lit(c).alias("column"),
                     F.col(f"_k{k}").alias("checked"), F.col(f"_f{k}").alias("failed"))
            for k, (n, c) in enumerate(meta)]
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
