"""A key holding a third of all rows: results stay exact and AQE splits the hot partition."""

import duckdb
from pyspark.sql import functions as F

from helpers import rows_of

from bizlens.operators.quantiles import exact_quantiles
from bizlens.plans import orders as rp
from bizlens.sources.mart import order_facts
from bizlens.sources.tables import load_tables
from conftest import SF_SMALL


def _skewed_orders(spark):
    """Orders plus copies of them re-keyed to one customer, until that customer
    holds about a third of all rows (derived from the given table)."""
    o = load_tables(spark, SF_SMALL)["orders"]
    hot = (o.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(2)) == 0)
            .withColumn("o_orderkey", F.col("o_orderkey") + F.lit(10 ** 9))
            .withColumn("o_custkey", F.lit(1).cast("long")))
    # many map tasks, as on a cluster: a hot partition is split along map outputs
    return o.unionByName(hot).repartition(8)


def test_hot_customer_reports_match_duckdb(spark):
    skewed = _skewed_orders(spark)
    pdf = skewed.toPandas()
    con = duckdb.connect()
    con.register("orders", pdf)
    n_hot = int((pdf["o_custkey"] == 1).sum())
    assert 0.25 * len(pdf) <= n_hot <= 0.45 * len(pdf)
    t = {"orders": skewed}
    got = rp.cohort_retention(order_facts(t), "user_id", "create_date").toPandas()
    want = con.sql("""
        WITH cm AS (SELECT DISTINCT o_custkey AS u, date_trunc('month', o_orderdate) AS m FROM orders),
        fc AS (SELECT u, m, min(m) OVER (PARTITION BY u) AS c FROM cm)
        SELECT strftime(c, '%Y-%m-%d') AS cohort_month, strftime(m, '%Y-%m-%d') AS purchase_month,
               CAST((year(m) - year(c)) * 12 + month(m) - month(c) AS INTEGER) AS months_since_first_purchase,
               count(*) AS num_customers FROM fc GROUP BY 1, 2, 3""").df()
    assert rows_of(got) == rows_of(want)


def test_hot_group_quantiles_exact(spark):
    skewed = _skewed_orders(spark).withColumn("g", (F.col("o_custkey") == 1).cast("int"))
    got = {r["g"]: (r["q25"], r["q5"], r["q75"]) for r in
           exact_quantiles(skewed, "o_totalprice", [0.25, 0.5, 0.75], by="g", sort_rows=5).collect()}
    con = duckdb.connect()
    con.register("s", skewed.select("g", "o_totalprice").toPandas())
    want = con.sql("SELECT g, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) FROM s GROUP BY 1").fetchall()
    for g, qs in want:
        assert [round(x, 6) for x in got[g]] == [round(x, 6) for x in qs]


def test_aqe_splits_the_hot_join_partition(spark):
    skewed = _skewed_orders(spark)
    cust = load_tables(spark, SF_SMALL)["customer"]
    # thresholds scaled down to the fixture (production: the session defaults / configure_for_scale)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "500",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = skewed.join(cust, skewed.o_custkey == cust.c_custkey).select("o_orderkey", "c_mktsegment")
        qe = df._jdf.queryExecution()
        total = qe.toRdd().count()
        plan = qe.executedPlan().toString()
        assert total == skewed.count()
        assert "SortMergeJoin(skew=true)" in plan and "AQEShuffleRead skewed" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_quantiles_with_an_outlier_rank_few_rows(spark):
    """One value at 1e18 and heavy ties: no interval keeps more than a few rows for one task."""
    import numpy as np
    x = np.concatenate([np.arange(60_000) % 1000, np.full(20_000, 500.0), [1e18, -1e18]]).astype(float)
    df = spark.range(len(x)).select((F.col("id") % 2).alias("half"), F.lit(0).alias("g"), F.col("id").alias("i"))
    df = df.join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double"), "i")
    row = exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.9, 1.0], by="g", names=list("abcde"), sort_rows=300).first()
    assert [row[c] for c in "abcde"] == [float(v) for v in np.quantile(x, [0, 0.1, 0.5, 0.9, 1])]
    out = exact_quantiles(df, "x", [0.5], by="g", sort_rows=300)
    assert out.first()["q5"] == float(np.quantile(x, 0.5))


def test_quantile_rows_are_not_shuffled_by_group(spark):
    """With a small broadcast threshold the raw rows still meet the table of groups without an exchange."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        li = load_tables(spark, SF_SMALL)["lineitem"].select("l_returnflag", "l_quantity")
        from bizlens.operators.quantiles import _beside
        state = li.groupBy("l_returnflag").agg(F.count("*").alias("_n"))
        plan = _beside(li, state, ["l_returnflag"])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
