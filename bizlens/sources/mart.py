"""Order-mart adapter.

The order reports are written against a food-delivery order mart:

    order_table(order_id, user_id, merchant_id, district_id, city_id,
                create_date, create_time, order_status, payment_method,
                order_distance, order_value_amount_usd, service_fee_usd,
                gmv_usd, exchange_rate)
    district_info(district_id, district_name, city_id)
    city_info(city_id, city_name)
    merchant_info(merchant_id, merchant_name)
    merchant_segment(merchant_id, merchant_segment)

``OrderMart`` holds those five frames. A real mart is passed in directly; for
the star-schema test tables the functions below derive one:

* order level  - orders x customer x nation: district = nation, city = region,
  status ``F`` plays "cancel", priority plays the payment method, amount is
  the order total.
* line level   - lineitem x (order level): each line is one delivery, the part
  is the merchant (name, brand or type), quantity is the distance, extended
  price is GMV and GMV x tax is the service fee. Its ``order_id`` is
  ``l_orderkey * 10 + l_linenumber``, which is *not* unique in the test
  tables (line numbers repeat within an order), so distinct counts stay exact.
* events       - event timestamps supply ``create_time``.

Dimension frames of a fixed, data-independent size (``bounded_dims``) are
broadcast explicitly; everything that grows with the data is left to
Catalyst's size estimate and AQE's runtime statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the test-table mapping.
EXCHANGE_RATE = "1.5"
CANCEL_STATUS = "F"
# Parameters of the derived bookings target.
CANCEL_LEAD_TIME, CANCEL_PRICE = 1800, 90000


@dataclass(frozen=True)
class OrderMart:
    order_table: DataFrame
    district_info: DataFrame
    city_info: DataFrame
    merchant_info: DataFrame | None = None
    merchant_segment: DataFrame | None = None
    bounded_dims: frozenset = field(default_factory=frozenset)

    def dim(self, name: str) -> DataFrame:
        """A dimension frame, with a broadcast hint only when its size is fixed."""
        df = getattr(self, name)
        if df is None:
            raise ValueError(f"this mart has no {name}")
        return F.broadcast(df) if name in self.bounded_dims else df


def _dims(t) -> dict:
    nation, region, part = t["nation"], t["region"], t["part"]
    return dict(
        district_info=nation.select(
            F.col("n_nationkey").cast("bigint").alias("district_id"),
            F.col("n_name").alias("district_name"),
            F.col("n_regionkey").cast("bigint").alias("city_id")),
        city_info=region.select(
            F.col("r_regionkey").cast("bigint").alias("city_id"),
            F.col("r_name").alias("city_name")),
        # TPC-H nation/region have 25 and 5 rows at every scale factor
        bounded_dims=frozenset({"district_info", "city_info"}),
        _part=part,
    )


def order_facts(t) -> DataFrame:
    """Order columns that need no dimension (id, user, date, status, payment,
    amount): reports that use only these skip the customer join entirely."""
    return t["orders"].select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("create_date"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("order_value_amount_usd"))


def _order_level(t) -> DataFrame:
    o, c, n = t["orders"], t["customer"], t["nation"]
    cust = c.select("c_custkey", "c_nationkey", "c_mktsegment")
    nat = F.broadcast(n.select("n_nationkey", "n_regionkey"))
    return (o.join(cust, o.o_custkey == cust.c_custkey)
             .join(nat, cust.c_nationkey == nat.n_nationkey)
             .select(
                 F.col("o_orderkey").alias("order_id"),
                 F.col("o_custkey").alias("user_id"),
                 F.col("c_nationkey").cast("bigint").alias("district_id"),
                 F.col("n_regionkey").cast("bigint").alias("city_id"),
                 F.col("o_orderdate").cast("date").alias("create_date"),
                 F.col("o_orderstatus").alias("order_status"),
                 F.col("o_orderpriority").alias("payment_method"),
                 F.col("o_totalprice").cast("decimal(18,2)").alias("order_value_amount_usd"),
                 F.lit(EXCHANGE_RATE).cast("decimal(18,4)").alias("exchange_rate"),
                 F.col("c_mktsegment").alias("customer_segment")))


def orders_mart(t) -> OrderMart:
    """Order-level mart from the star-schema tables ``t`` (name -> DataFrame)."""
    d = _dims(t)
    return OrderMart(order_table=_order_level(t), district_info=d["district_info"],
                     city_info=d["city_info"], bounded_dims=d["bounded_dims"])


def lines_mart(t, merchant_name_from: str = "p_name", order_level: DataFrame | None = None,
               lineitem: DataFrame | None = None, with_geo: bool = True) -> OrderMart:
    """Line-level mart: one delivery per line item, the part is the merchant.

    ``merchant_name_from`` picks the part attribute that names a merchant
    (``p_name``, ``p_brand`` ...); the segment is always ``p_type``.
    ``order_level``/``lineitem`` may be given pre-materialised (see
    :func:`bizlens.sources.layout.materialize_order_mart`): when both are
    bucketed on the order key their join needs no shuffle. ``with_geo=False``
    leaves out district and city, and with them the customer join (for
    reports that group by merchant and date only).
    """
    d = _dims(t)
    part = d["_part"]
    li = lineitem if lineitem is not None else t["lineitem"]
    if order_level is not None:
        base_orders = order_level
    else:
        base_orders = _order_level(t) if with_geo else order_facts(t).withColumn(
            "exchange_rate", F.lit(EXCHANGE_RATE).cast("decimal(18,4)"))
    orders = base_orders.drop("order_value_amount_usd", "customer_segment")
    geo = ["district_id", "city_id"] if "city_id" in orders.columns else []
    gmv = F.col("l_extendedprice").cast("decimal(18,2)")
    lines = (li.join(orders, li.l_orderkey == orders.order_id)
               .select(
                   (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_id"),
                   "user_id",
                   F.col("l_partkey").alias("merchant_id"),
                   *geo, "create_date",
                   "order_status", "payment_method",
                   F.col("l_quantity").alias("order_distance"),
                   gmv.alias("gmv_usd"),
                   gmv.alias("order_value_amount_usd"),
                   (gmv * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,4)").alias("service_fee_usd"),
                   "exchange_rate"))
    merchant_info = part.select(F.col("p_partkey").alias("merchant_id"),
                                F.col(merchant_name_from).alias("merchant_name"))
    merchant_segment = part.select(F.col("p_partkey").alias("merchant_id"),
                                   F.col("p_type").alias("merchant_segment"))
    return OrderMart(order_table=lines, district_info=d["district_info"], city_info=d["city_info"],
                     merchant_info=merchant_info, merchant_segment=merchant_segment,
                     bounded_dims=d["bounded_dims"])


def events_as_orders(t) -> DataFrame:
    """Orders carrying a time of day: one per event, ``create_time`` = event time."""
    return t["events"].select(F.col("event_id").alias("order_id"),
                              F.col("user_id"),
                              F.col("ts").alias("create_time"))


def _customer_region(t) -> DataFrame:
    """Customer key with its segment and region name. Nation (25 rows) and
    region (5 rows) have a fixed size at every scale: broadcast them."""
    return (t["customer"].select("c_custkey", "c_nationkey", "c_mktsegment")
            .join(F.broadcast(t["nation"].select("n_nationkey", "n_regionkey")),
                  F.col("c_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(t["region"].select("r_regionkey", "r_name")),
                  F.col("n_regionkey") == F.col("r_regionkey"))
            .select("c_custkey", "c_mktsegment", "r_name"))


# The five raw spellings of the claim cause in the claims data.
CAUSE_SPELLINGS = [" Meat", "VEGETABLES", "meat", "unknown", "vegetable"]


def claims_frame(t) -> DataFrame:
    """A claims table derived from orders (one claim per order).

    claim_id = order key; time_to_close = days from order to its last ship
    date; claim_amount = ``'R$ '`` + order total as text; location = region
    name; amount_paid = 70 % of the total, missing for every 50th key;
    individuals_on_claim = line count; linked_cases = urgent/high priority,
    missing for every 40th key; cause = one of the five raw spellings.
    """
    o, li = t["orders"], t["lineitem"]
    lines = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("_last_ship"),
                                         F.count(F.lit(1)).alias("_lines"))
    geo = _customer_region(t).select("c_custkey", "r_name")
    key = F.col("o_orderkey")
    spellings = F.array(*[F.lit(s) for s in CAUSE_SPELLINGS])
    return (o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
             .join(geo, o.o_custkey == geo.c_custkey, "left")
             .select(
                 key.alias("claim_id"),
                 F.datediff(F.col("_last_ship").cast("date"), F.col("o_orderdate").cast("date")).alias("time_to_close"),
                 F.concat(F.lit("R$ "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("claim_amount"),
                 F.col("r_name").alias("location"),
                 F.when(key % 50 == 0, F.lit(None)).otherwise(
                     (F.col("o_totalprice").cast("decimal(18,2)") * F.lit("0.7").cast("decimal(2,1)")).cast("double")).alias("amount_paid"),
                 F.col("_lines").cast("int").alias("individuals_on_claim"),
                 F.when(key % 40 == 0, F.lit(None).cast("boolean")).otherwise(
                     F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("linked_cases"),
                 F.element_at(spellings, (key % 5 + 1).cast("int")).alias("cause")))


def bookings_frame(t) -> DataFrame:
    """A bookings-like table derived from orders (one booking per order).

    Categoricals: priority (meal plan), customer segment (market segment),
    region, number of lines (counts are treated as categories); numerics:
    price per line (room price), days to last ship (lead time), total quantity;
    date parts of the order date. Target: a long lead time or a high room price
    means Canceled, and every tenth key is turned round, so a model can learn it
    but for a tenth of the rows.
    """
    o, li = t["orders"], t["lineitem"]
    lines = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("_last_ship"),
                                         F.count(F.lit(1)).alias("_lines"),
                                         F.sum("l_quantity").alias("_qty"))
    geo = _customer_region(t).select("c_custkey", "c_mktsegment", "r_name")
    lead = F.datediff(F.col("_last_ship").cast("date"), F.col("o_orderdate").cast("date"))
    price = F.round(F.col("o_totalprice") / F.col("_lines"), 2)
    cancelled = ((lead > CANCEL_LEAD_TIME) | (price > CANCEL_PRICE)) != (F.col("o_orderkey") % 10 == 0)
    return (o.join(lines, o.o_orderkey == lines.l_orderkey)
             .join(geo, o.o_custkey == geo.c_custkey)
             .select(
                 F.col("o_orderkey").alias("Booking_ID"),
                 F.col("o_orderpriority").alias("type_of_meal_plan"),
                 F.col("c_mktsegment").alias("market_segment_type"),
                 F.col("r_name").alias("region"),
                 F.col("_lines").cast("int").alias("no_of_items"),
                 lead.alias("lead_time"),
                 F.year("o_orderdate").alias("arrival_year"),
                 F.month("o_orderdate").alias("arrival_month"),
                 F.dayofmonth("o_orderdate").alias("arrival_date"),
                 F.col("_qty").alias("total_quantity"),
                 price.alias("avg_price_per_room"),
                 F.when(cancelled, F.lit("Canceled")).otherwise(F.lit("Not_Canceled")).alias("booking_status")))
