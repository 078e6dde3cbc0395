"""The streamed busiest-hours report equals the batch report."""

import tempfile

from helpers import rows_of

from bizlens.plans import orders as rp
from bizlens.sources.tables import load_table
from bizlens.streaming import hour_of_day_counts, start_report_stream
from conftest import SF_SMALL


def test_stream_matches_batch(spark):
    events = load_table(spark, SF_SMALL, "events")
    stream = (spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet")
              .parquet(SF_SMALL).withColumnRenamed("ts", "create_time"))
    ck = tempfile.mkdtemp(prefix="bizlens-stream-")
    q = start_report_stream(hour_of_day_counts(stream), "busiest_hours_test", sink_table="busiest_hours_stream",
                            checkpoint=ck)
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.table("global_temp.busiest_hours_stream").toPandas()
    want = rp.busiest_hours(events.withColumnRenamed("ts", "create_time")).toPandas()
    assert rows_of(got) == rows_of(want)


def test_weekday_stream_matches_batch(spark):
    from bizlens.streaming import weekday_counts
    orders = load_table(spark, SF_SMALL, "orders")
    stream = (spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet")
              .parquet(SF_SMALL).withColumnRenamed("o_orderdate", "create_date"))
    ck = tempfile.mkdtemp(prefix="bizlens-stream-")
    q = start_report_stream(weekday_counts(stream), "busiest_weekdays_test", sink_table="busiest_weekdays_stream",
                            checkpoint=ck)
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.table("global_temp.busiest_weekdays_stream").toPandas()
    want = rp.busiest_weekdays(orders.withColumnRenamed("o_orderdate", "create_date")).toPandas()
    assert rows_of(got) == rows_of(want)
