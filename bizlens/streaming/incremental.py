"""Incremental versions of the busiest-hour / busiest-weekday reports.

The batch reports count orders per hour of day (or weekday) and keep the
extremes. Counting is a mergeable aggregate, so a stream can maintain it: the
state holds one row per hour (24) or weekday (7) whatever the input volume,
and every micro-batch recomputes the extremes from that state in
``foreachBatch`` (a small frame) and writes the report. Progress and state are
kept in the checkpoint folder, so a restarted query resumes exactly once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bizlens.operators.ranking import extremes


def hour_of_day_counts(stream: DataFrame, time_col: str = "create_time") -> DataFrame:
    """Running order count per hour of day (complete-mode aggregate, 24 keys)."""
    return stream.groupBy(F.hour(time_col).alias("hour_of_day")).agg(F.count(F.lit(1)).alias("no_order"))


def weekday_counts(stream: DataFrame, date_col: str = "create_date") -> DataFrame:
    """Running order count per weekday, Sunday = 1 (complete-mode aggregate, 7 keys)."""
    return stream.groupBy(F.dayofweek(date_col).alias("day_of_week")).agg(F.count(F.lit(1)).alias("no_order"))


def stream_checkpoint_location(spark: SparkSession, name: str) -> str:
    """``<spark.checkpoint.dir>/streams/<name>``: the shared reliable folder of the cluster."""
    from bizlens.session import checkpoint_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "streams", name)


def start_report_stream(counts: DataFrame, name: str, output_path: str | None = None,
                        sink_table: str | None = None, available_now: bool = True,
                        checkpoint: str | None = None) -> StreamingQuery:
    """Run a count stream and publish the extremes after every micro-batch.

    ``output_path`` receives the report as parquet (overwritten per batch);
    ``sink_table`` registers it as a global temp view ``global_temp.<name>``
    instead (micro-batches run in a cloned session; tests, notebooks).
    """
    spark = counts.sparkSession
    value_col = "no_order"

    def publish(batch: DataFrame, epoch_id: int) -> None:
        report = extremes(batch, value_col)
        if output_path:
            report.write.mode("overwrite").parquet(output_path)
        if sink_table:
            # the report has at most 24 rows; keep it beyond the batch
            rows = report.collect()
            batch.sparkSession.createDataFrame(rows, report.schema).createOrReplaceGlobalTempView(sink_table)

    writer = (counts.writeStream.outputMode("complete").queryName(name)
              .option("checkpointLocation", checkpoint or stream_checkpoint_location(spark, name))
              .foreachBatch(publish))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
