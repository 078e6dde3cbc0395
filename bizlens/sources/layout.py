"""Co-located storage for repeated line-level reports.

Every line-level report joins ``lineitem`` to the order-level view (orders x
customer x nation) on the order key. Written once bucketed and sorted on that
key (same bucket count on both sides), the tables join with a sort-merge join
that needs no exchange on either side, for every later report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bizlens.sources.mart import OrderMart, _order_level, lines_mart, orders_mart


def _write_bucketed(df: DataFrame, table: str, key: str, buckets: int, location: str | None) -> None:
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if location:
        w = w.option("path", location)
    w.saveAsTable(table)


def materialize_order_mart(spark: SparkSession, t, buckets: int, prefix: str = "bizlens",
                           location: str | None = None) -> dict[str, str]:
    """Write the order-level view and lineitem bucketed by order key.

    ``location`` is a shared folder (tables become external tables there);
    without it the session warehouse is used. Returns the table names.
    """
    names = {"order_level": f"{prefix}_order_level", "lineitem": f"{prefix}_lineitem"}
    _write_bucketed(_order_level(t), names["order_level"], "order_id", buckets,
                    f"{location.rstrip('/')}/order_level" if location else None)
    _write_bucketed(t["lineitem"], names["lineitem"], "l_orderkey", buckets,
                    f"{location.rstrip('/')}/lineitem" if location else None)
    return names


def bucketed_lines_mart(spark: SparkSession, t, names: dict[str, str],
                        merchant_name_from: str = "p_name") -> OrderMart:
    """Line-level mart over the bucketed tables written by :func:`materialize_order_mart`."""
    return lines_mart(t, merchant_name_from, order_level=spark.table(names["order_level"]),
                      lineitem=spark.table(names["lineitem"]))


def bucketed_orders_mart(spark: SparkSession, t, names: dict[str, str]) -> OrderMart:
    """Order-level mart over the materialised order view: the customer join that
    locates district and city was paid once, at write time."""
    m = orders_mart(t)
    return OrderMart(order_table=spark.table(names["order_level"]), district_info=m.district_info,
                     city_info=m.city_info, bounded_dims=m.bounded_dims)
