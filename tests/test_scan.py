"""Order over whole frames, dictionaries and one-hot vectors: exact, without a window or a list of all rows."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bizlens.operators import features, scan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _skewed(spark, n=3000):
    """One value holds a third of the rows; nulls; many partitions."""
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 != 1, (F.col("id") * 7919) % 400).alias("v")).repartition(9)


def test_row_index_is_gapless_and_ordered(spark):
    df = _skewed(spark)
    out = scan.row_index(df, [F.col("v").desc_nulls_last(), "id"])
    rows = sorted(out.collect(), key=lambda r: r["index"])
    assert [r["index"] for r in rows] == list(range(3000))
    assert [(r.v, r.id) for r in rows] == sorted(((r.v, r.id) for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert "Window" not in _plan(out) and "SinglePartition" not in _plan(out)
    ties = [r["index"] for r in scan.row_index(df, "v").where("v = 7").collect()]
    assert sorted(ties) == list(range(min(ties), min(ties) + len(ties)))


def test_a_hot_value_spreads_over_ranges(spark):
    """Equal values are dealt by a running number: several tasks hold them."""
    df = spark.range(4000).select(F.lit(1).alias("v"), "id")
    out = scan.running_total(df, "v", "id", "t")
    parts = out._jdf.queryExecution().analyzed().toString()
    assert "_part" in parts
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        wide = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("v", "_row")
        assert wide.select(F.spark_partition_id()).distinct().count() > 1
        assert out.agg(F.max("t")).first()[0] == 3999 * 2000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_rows_as_read_keep_their_places(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 3).alias("x"), F.lit(0).alias("index"))
    out = scan.row_index(df)
    assert out.columns == ["x", "index"] and all(r["index"] * 3 == r.x for r in out.collect())
    assert scan.row_index(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "double", "decimal(18,2)"])
def test_running_total(spark, kind):
    df = _skewed(spark, 900).withColumn("w", F.expr(f"cast(nullif(id % 10, 3) as {kind})"))
    out = scan.running_total(df, ["v", "id"], "w", "total")
    rows = sorted(out.collect(), key=lambda r: (r.v is not None, r.v or 0, r.id))
    want, seen = [], None
    for r in rows:
        seen = seen if r.w is None else r.w + (seen or 0)
        want.append(seen)
    assert [r.total for r in rows] == want
    plan = _plan(out)
    assert "SinglePartition" not in plan
    assert scan.running_total(df.limit(0), "v", "w").count() == 0
    assert scan.running_total(df.where("id < 2").withColumn("w", F.lit(None).cast("long")), "id", "w").agg(F.count("cumulative")).first()[0] == 0


def test_ranks_over_all_rows(spark):
    df = _skewed(spark)
    rows = df.collect()
    levels = sorted({r.v for r in rows if r.v is not None}, reverse=True) + [None]
    dense = {v: i + 1 for i, v in enumerate(levels)}
    counts = {v: sum(r.v == v for r in rows) for v in levels}
    gaps, before = {}, 1
    for v in levels:
        gaps[v] = before
        before += counts[v]
    for flag, want in ((True, dense), (False, gaps)):
        out = scan.global_rank(df, "v", dense=flag)
        assert {(r.id, r["rank"]) for r in out.collect()} == {(r.id, want[r.v]) for r in rows}
        assert "SinglePartition" not in _plan(out)
    low = scan.global_rank(df, "v", descending=False)
    assert low.where("rank = 1").select("v").distinct().collect() == [(0,)]
    top = scan.top_global(df, "v", (1, 3))
    assert {r.v for r in top.collect()} == {levels[0], levels[2]}


def test_side_by_side(spark):
    a = spark.range(10, numPartitions=3).select("id", (F.col("id") * 2).alias("x"))
    b = spark.range(25, numPartitions=4).select((100 - F.col("id")).alias("id"), F.col("id").cast("string").alias("y"))
    out = scan.side_by_side(a, b)
    assert out.columns == ["id", "x", "id_right", "y"]
    rows = sorted(out.collect(), key=lambda r: -r.id_right)
    assert [tuple(r) for r in rows] == [(i, 2 * i, 100 - i, str(i)) if i < 10 else (None, None, 100 - i, str(i)) for i in range(25)]
    ordered = scan.side_by_side(a, b, F.col("id").desc(), "id").collect()
    assert {(r.id, r.id_right) for r in ordered} >= {(9, 76), (0, 85), (None, 86)}


# ------------------------------------------------------------ dictionaries
def test_dictionary_of_many_levels(spark):
    """Far more levels than a range holds, several columns in one go, no list of them on the driver."""
    df = spark.range(30_000).select(F.concat(F.lit("k"), (F.col("id") * 7 % 20_011).cast("string")).alias("a"),
                                    F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("b"))
    got = {(r.column, r.level): r.code for r in features.dictionary(df, ["a", "b"]).collect()}
    a = sorted({f"k{i * 7 % 20_011}" for i in range(30_000)})
    assert got == {(0, v): i for i, v in enumerate(a)} | {(1, str(i)): i for i in range(5)}


def test_label_encode_defines_nulls_and_names(spark):
    rows = [("b", None, "é", 1), (None, None, "z", 2), ("a", None, "🙂", 3), ("b", None, "￿", 4)]
    df = spark.createDataFrame(rows, "`x.y` string, empty string, u string, level int")
    out = features.label_encode(df, ["x.y", "empty", "u"])
    assert out.columns == df.columns
    got = sorted((r.level, r["x.y"], r.empty, r.u) for r in out.collect())
    assert got == [(1, 1, None, 1), (2, None, None, 0), (3, 0, None, 3), (4, 1, None, 2)]  # order of UTF-8 bytes
    more = features.label_encode(df, ["u"], suffix="_code")
    assert more.columns == [*df.columns, "u_code"] and dict(more.dtypes)["u"] == "string"
    assert features.label_encode(df, ["u"], suffix="", max_levels=4).count() == 4
    with pytest.raises(ValueError, match="4 levels"):
        features.label_encode(df, ["u"], max_levels=3)
    assert features.label_encode(df.limit(0), ["u"]).count() == 0


def test_one_hot_names_are_written_once(spark):
    df = spark.createDataFrame([("x", 1, "y_x"), ("y", 2, "z")], "a string, a_x int, b string")
    out = features.one_hot(df, ["a", "b"])
    assert out.columns == ["a_x", "a_x#2", "a_y", "b_y_x", "b_z"] and len(set(out.columns)) == 5
    assert [tuple(r) for r in out.orderBy("a_x").collect()] == [(1, 1, 0, 1, 0), (2, 0, 1, 0, 1)]
    with pytest.raises(ValueError, match="more than 1 levels"):
        features.one_hot(df, ["a"], max_levels=1)


def test_ones_of_a_wide_vector(spark):
    # written out as arrays these rows would need 16 GB each
    wide, n = Vectors.sparse(2_000_000_000, [3, 7, 1_999_999_999], [1.0, 2.0, 1.0]), None
    df = spark.createDataFrame([(1, wide), (2, Vectors.dense([0.0, 1.0, 1.0])), (3, Vectors.sparse(4, [], [])), (4, n)], schema=StructType([
        StructField("id", LongType()), StructField("v", VectorUDT())]))
    got = {r.id: r.o for r in df.select("id", features.ones("v").alias("o")).collect()}
    assert (got[1].width, got[1].places) == (2_000_000_000, [3, 1_999_999_999])
    assert (got[2].width, got[2].places) == (3, [1, 2]) and (got[3].width, got[3].places) == (4, []) and got[4] is None


def test_one_hot_vector(spark):
    df = spark.range(2000).select("id", F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("wide"),
                                  F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("narrow"), F.lit(None).cast("string").alias("none"))
    out = features.one_hot_vector(df, ["wide", "narrow", "none"], "wide_vector")
    assert out.columns == ["id", "wide", "narrow", "none", "wide_vector"]
    for r in out.where("id in (0, 5, 1999)").collect():
        assert r.wide_vector.size == 2003
        assert r.wide_vector.indices.tolist() == ([r.id] if r.id % 4 == 0 else [r.id, 2000 + r.id % 4 - 1])
    assert len(out.columns) == 5 and features.one_hot_vector(df.limit(0), ["wide"]).count() == 0
    dense = features.one_hot_vector(df.where("id < 9"), ["narrow"]).select("id", vector_to_array("features").alias("v")).collect()
    wide = {r.id: [r.narrow_1, r.narrow_2, r.narrow_3] for r in features.one_hot(df.where("id < 9"), ["narrow"]).collect()}
    assert all(np.array_equal(r.v, wide[r.id]) for r in dense)
