"""Intermediate tables in the shared folder of the cluster, and connected components over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.session import materialise, release  # noqa: F401  (the operators take both from here)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Bound the rows that a Python worker gets at a time, unless the session has its own bound.

    Texts make wide rows: Spark's default of 10,000 rows is tens of megabytes in the executor and again in the worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(rows))


def gather(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` in one partition for ``each`` of ``rows``, but for every core, without a shuffle: a small table is not
    written as a file for each shuffle partition. The number of partitions never grows."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): one row (node, root) per node
    that has an edge to another node; ``root`` is the smallest node of its component.

    Alternating large-star and small-star steps; every step is a grouped minimum and a join
    on the node, so a node with very many edges is pre-aggregated and its join side can be
    split. Edges with a null end and loops are ignored; no edges give no rows.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), "edges")
    rows = e.count()
    few = lambda df: gather(df, rows, 200_000)  # noqa: E731  (the steps never have more edges than these, both ways)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = few(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialise(few(small), "stars")
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == (now.n, now.x):
            break
        seen = (now.n, now.x)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
