"""Exact quantiles without gathering a group in one task (PR2, DS3).

``percentile`` keeps every distinct value of a group in one aggregation
buffer, and a rank window sorts a whole group in one task; with a key holding a
third of the rows either would put that third on one executor. Instead:

1. one mergeable KLL sketch per group, made beside the counts in the first scan, gives values at evenly
   spaced ranks; the points on both sides of a wanted rank, further out than the sketch errs,
   are the ends of an interval. All wanted ranks are read from the same sketch;
2. one more scan counts the rows below each interval and the rows of each distinct value inside. The
   order statistics are found among those values, and their place shows whether the interval held them.

An interval keeps about ``2 * SLACK / GRID`` of the rows, whatever their values, since ranks and not values are
divided; equal values are one row. Where that is more than ``sort_rows``, the interval is counted and narrowed by
a sketch of the rows inside first. Groups of at most ``sort_rows`` rows need no interval. A sketch that erred by more than
``SLACK`` is found out by the counts; the interval is then drawn anew, four times as wide.

Quantiles use linear interpolation between the order statistics at
``floor(h)`` and ``ceil(h)``, ``h = (n - 1) * p`` (the numpy/pandas default).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.ratios import number
from bizlens.session import reliable

#: Size of a sketch (its ranks err by 0.07 % of the rows at most, 99 times in 100), evenly spaced points read
#: from it, and points that an interval reaches beyond its rank (0.3 % of the rows).
SKETCH, GRID, SLACK = 4096, 1024, 3
#: Rows of an interval that are ranked directly.
SORT_ROWS = 200_000
#: Groups whose intervals are broadcast to the rows; beyond, they are joined.
BROADCAST_GROUPS = 50_000


def _pname(p: float) -> str:
    s = f"{p:.6f}".rstrip("0").rstrip(".")
    return "q" + s.replace("0.", "", 1) if s.startswith("0.") else "q" + s.replace(".", "_")


def _beside(x: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the intervals of their group."""
    few = state.count() <= BROADCAST_GROUPS
    return x.join(F.broadcast(state) if few else state, keys)


def _points(rows: Column, sort_rows: int) -> Column:
    """Values at evenly spaced ranks, of groups that need an interval (an empty sketch cannot be read)."""
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return F.when(rows > sort_rows, F.kll_sketch_get_quantile_double("_sketch", grid))


def _sketch() -> Column:
    return F.kll_sketch_agg_double("_x", SKETCH).alias("_sketch")


def _ends(points: str, rank: Column, below: Column, rows: Column, slack: int) -> tuple[Column, Column]:
    """Ends around a rank among ``rows`` sketched rows that ``below`` others precede; null is unbounded."""
    at = F.try_divide(rank - below, rows) * GRID
    low, high = F.floor(at).cast("int") - slack, F.ceil(at).cast("int") + slack
    return F.when(low >= 0, F.get(points, low)), F.when(high <= GRID, F.get(points, high))


def _inside(k: int) -> Column:
    """Is the row in the closed interval of quantile ``k``."""
    lo, hi = F.col(f"_lo{k}"), F.col(f"_hi{k}")
    return (lo.isNull() | (F.col("_x") >= lo)) & (hi.isNull() | (F.col("_x") <= hi))


def _narrowed(x: DataFrame, state: DataFrame, keys: list[str], count: int, sort_rows: int, slack: int) -> DataFrame:
    """Count the intervals and divide those that hold too many rows, as long as that halves one of them."""
    before = None
    while True:
        counts = _beside(x, state, keys).groupBy(*keys).agg(*[c for k in range(count) for c in (
            F.count_if(F.col("_x") < F.col(f"_lo{k}")).alias(f"_below{k}"), F.count_if(_inside(k)).alias(f"_rows{k}"))])
        state = reliable(state.join(counts, keys))
        sizes = F.array(*[F.col(f"_rows{k}") for k in range(count)])
        wide = state.select(*keys, F.posexplode(sizes).alias("_k", "_rows")).where(F.col("_rows") > sort_rows)
        total = wide.agg(F.max("_rows")).first()[0] or 0
        if total <= sort_rows or (before is not None and 2 * total > before):
            return state.drop(*[f"{c}{k}" for k in range(count) for c in ("_below", "_rows")])
        before = total
        hits = F.array_compact(F.array(*[F.when((F.col(f"_rows{k}") > sort_rows) & _inside(k), F.lit(k)) for k in range(count)]))
        points = (_beside(x, state, keys).select(*keys, "_x", F.explode(hits).alias("_k")).groupBy(*keys, "_k")
                  .agg(F.count("_x").alias("_rows"), _sketch()).withColumn("_grid", _points(F.col("_rows"), sort_rows)))
        grids = points.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, F.col("_grid"))).alias(f"_grid{k}") for k in range(count)])
        state = state.join(grids, keys, "left")
        for k in range(count):
            lo, hi = _ends(f"_grid{k}", F.col(f"_h{k}"), F.col(f"_below{k}"), F.col(f"_rows{k}"), slack)
            divided = F.col(f"_grid{k}").isNotNull()
            state = (state.withColumn(f"_hi{k}", F.when(divided, F.coalesce(hi, f"_hi{k}")).otherwise(F.col(f"_hi{k}")))
                     .withColumn(f"_lo{k}", F.when(divided, F.coalesce(lo, f"_lo{k}")).otherwise(F.col(f"_lo{k}"))))
        state = reliable(state.drop(*[f"{c}{k}" for k in range(count) for c in ("_grid", "_below", "_rows")]))


def grouped_quantiles(df: DataFrame, value: str, probs, keys: list[str], names: list[str], sort_rows: int = SORT_ROWS,
                      also: tuple[Column, ...] = ()) -> DataFrame:
    """``keys``, ``n``, the aggregates ``also`` (over ``_x``, the value as a double, null where missing) and a column
    per probability, null in groups without a value. A null key is a group. Two scans of ``df``, which is not written
    anywhere."""
    count, user_keys, keys = len(probs), keys, ["_key"]  # fields of a struct join as equal when null
    x = df.select(F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(user_keys)]).alias("_key"), number(value).alias("_x"))
    first = (x.groupBy(*keys).agg(F.count("_x").alias("_n"), *also, _sketch())
             .withColumn("_grid", _points(F.col("_n"), sort_rows)).drop("_sketch"))
    first = reliable(first.select("*", *[((F.col("_n") - 1).cast("double") * F.lit(p)).alias(f"_h{k}") for k, p in enumerate(probs)]))
    most, slack = first.agg(F.max("_n")).first()[0] or 0, SLACK
    rows = x.where(F.col("_x").isNotNull())
    while True:
        state = first.select(*keys, *[F.col(f"_h{k}") for k in range(count)], *[c.alias(f"{name}{k}") for k in range(count) for name, c in zip(
            ("_lo", "_hi"), _ends("_grid", F.col(f"_h{k}"), F.lit(0), F.col("_n"), slack))])
        if most * (2 * slack + 1) > sort_rows * GRID:
            state = _narrowed(rows, state, keys, count, sort_rows, slack)
        # rows below an interval count as one null, those above not at all
        hits = F.array_compact(F.array(*[F.when(F.col("_x") < F.col(f"_lo{k}"), F.struct(F.lit(k).alias("k"), F.lit(None).cast("double").alias("x")))
                                         .when(_inside(k), F.struct(F.lit(k).alias("k"), F.col("_x").alias("x"))) for k in range(count)]))
        seen = (_beside(rows, state, keys).select(*keys, F.explode(hits).alias("_hit")).select(*keys, "_hit.k", "_hit.x")
                .groupBy(*keys, "k", "x").agg(F.count(F.lit(1)).alias("_c")))
        order = Window.partitionBy(*keys, "k").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        wanted = first.select(*keys, F.posexplode(F.array(*[F.col(f"_h{k}") for k in range(count)])).alias("k", "_h"))
        ranked = seen.withColumn("_end", F.sum("_c").over(order)).join(wanted, [*keys, "k"])
        at = lambda rank: F.min(F.when((F.col("_end") > rank(F.col("_h"))) & F.col("x").isNotNull(), F.col("x")))
        found = (ranked.groupBy(*keys, "k", "_h").agg(
            at(F.floor).alias("_low"), at(F.ceil).alias("_high"), F.sum("_c").alias("_all"),
            F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("_c"))), F.lit(0)).alias("_under")))
        part = F.col("_h") - F.floor("_h")
        # in order, or the interval missed the rank
        held = (F.floor("_h") >= F.col("_under")) & (F.ceil("_h") < F.col("_all"))
        wide = reliable(found.groupBy(*keys).agg(F.bool_and(held).alias("_held"), *[
            F.max(F.when(F.col("k") == k, F.col("_low") + (F.col("_high") - F.col("_low")) * part)).alias(f"_v{k}") for k in range(count)]))
        if not wide.where(~F.col("_held")).limit(1).count():
            break
        slack *= 4
    extra = [c for c in first.columns if c not in keys and not c.startswith(("_n", "_h", "_grid"))]
    out = first.select(*keys, F.col("_n").alias("n"), *extra).join(
        wide.select(*keys, *[F.col(f"_v{k}").alias(n) for k, n in enumerate(names)]), keys, "left")
    return out.select(*[F.col(f"_key.k{i}").alias(c) for i, c in enumerate(user_keys)], *out.columns[1:])


def exact_quantiles(df: DataFrame, value: str, probs, by=None, names: list[str] | None = None,
                    sort_rows: int = SORT_ROWS) -> DataFrame:
    """One row per group (or one row): keys, ``n`` and one column per probability.

    NULL and NaN values are missing; groups without a value have no row.
    """
    user_keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    # a constant key keeps the ungrouped case an equi-join on one-row tables
    keys = user_keys or ["_g"]
    probs = [float(p) for p in probs]
    names = names or [_pname(p) for p in probs]
    src = df if user_keys else df.withColumn("_g", F.lit(0))
    return grouped_quantiles(src, value, probs, keys, names, sort_rows).where("n > 0").select(*user_keys, "n", *names)


def approx_quantiles(df: DataFrame, value: str, probs, by=None, accuracy: int = 10_000,
                     names: list[str] | None = None) -> DataFrame:
    """One-pass quantiles from ``percentile_approx``: a mergeable per-task sketch
    (relative rank error about ``1 / accuracy``), for when one scan must do.
    Returns the same shape as :func:`exact_quantiles`; values are sample points
    (no interpolation)."""
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    probs = [float(p) for p in probs]
    names = names or [_pname(p) for p in probs]
    x = F.col(value).cast("double")
    q = F.percentile_approx(x, probs, accuracy)
    out = df.where(x.isNotNull()).groupBy(*keys).agg(F.count(x).alias("n"), q.alias("_q"))
    return out.select(*keys, "n", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
