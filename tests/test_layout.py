"""Bucketed order mart: same results, and the order-key join plans without an exchange."""

import tempfile

from helpers import rows_of

from bizlens.plans import orders as rp
from bizlens.sources.layout import bucketed_lines_mart, materialize_order_mart
from bizlens.sources.mart import lines_mart
from bizlens.sources.tables import load_tables
from conftest import SF_SMALL


def test_bucketed_mart_is_shuffle_free_and_equal(spark):
    t = load_tables(spark, SF_SMALL)
    loc = tempfile.mkdtemp(prefix="bizlens-bucketed-")
    names = materialize_order_mart(spark, t, buckets=4, prefix="t_layout", location=loc)
    m = bucketed_lines_mart(spark, t, names)
    joined = m.order_table
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan
    if "SortMergeJoin" in plan:
        assert "Exchange hashpartitioning(l_orderkey" not in plan
    got = rp.value_band_cancel(m, cancel_status="F").toPandas()
    want = rp.value_band_cancel(lines_mart(t), cancel_status="F").toPandas()
    assert rows_of(got) == rows_of(want)


def test_bucketed_orders_mart_equal(spark):
    from bizlens.sources.layout import bucketed_orders_mart
    from bizlens.sources.mart import orders_mart
    t = load_tables(spark, SF_SMALL)
    names = materialize_order_mart(spark, t, buckets=4, prefix="t_layout2",
                                   location=tempfile.mkdtemp(prefix="bizlens-bucketed-"))
    got = rp.value_band_pivot(bucketed_orders_mart(spark, t, names)).toPandas()
    want = rp.value_band_pivot(orders_mart(t)).toPandas()
    assert rows_of(got) == rows_of(want)
