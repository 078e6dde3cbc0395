"""Order-mart reports (RP1-RP12).

Each report is a function of an :class:`~bizlens.sources.mart.OrderMart` (or a
plain frame) plus the parameters the questions hard-code. Defaults follow the
*code* of the original questions where comments and code disagree (D8).

Plan shape, everywhere:
* filter the fact on raw columns first (half-open date ranges -> parquet
  pushed filters),
* aggregate by ids before joining names (partial aggregation shrinks the fact
  to one row per key and task before any shuffle),
* join dimensions of fixed size with a broadcast, others by Catalyst/AQE size,
* rank only aggregated frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.bands import (GMV_BANDS, GMV_TOP, ORDER_VALUE_BANDS, ORDER_VALUE_TOP,
                                     band, band_labels)
from bizlens.functions.periods import (hour_of_day, month_range, month_start, month_text, months_crossed,
                                       period_filter, weekday_sunday1)
from bizlens.functions.ratios import pct_rounded, safe_ratio
from bizlens.functions.text import contains_text
from bizlens.operators.aggregate import pivot_counts, rate_where
from bizlens.operators.ranking import extremes, top_ties
from bizlens.sources.mart import OrderMart

# The parameters the original questions hard-code, in question
# order. They are the report defaults; every one can be overridden.
FILTER_DISTRICT = "Go Vap"
FILTER_STATUS = "cancel"
FILTER_PAYMENT = "Cash"
FILTER_PERIOD = ("2022-04-01", "2022-07-31")
WALLET_MONTH = (2022, 7)
WALLET_PAYMENT = "E-Wallet"
MERCHANT_KEYWORDS = ("Xôi", "Bánh Mì")
DISTANCE_DISTRICTS = ("Hoan Kiem", "Binh Thanh")
MAX_DISTANCE_KM = 3.0
FEE_PERIOD = ("2022-06-01", "2022-12-31")
VND_PER_USD = 23000
SEGMENT_CITIES = ("Ha Noi City", "Da Nang City")
RETURN_CITY = "HCM City"
RETURN_MONTH = (2022, 7)
CANCEL_CITY_IDS = (217, 222)
CANCEL_PERIOD = ("2022-05-01", "2022-05-31")
CANCEL_STATUS = "cancel"


# --------------------------------------------------------------------- RP1
def cohort_retention(df: DataFrame, customer_col: str = "CustomerID",
                     date_col: str = "InvoiceDate") -> DataFrame:
    """Monthly retention cohorts.

    For every customer: the set of months with a purchase, built with one
    partially-aggregated ``collect_set`` (bounded by the number of calendar
    months in the data, whatever the number of rows). The cohort is the first
    of those months (``min`` ignores NULL dates, D7). Exploding the set gives one
    row per (customer, month), so a plain count equals the distinct count.
    """
    months = (df.where(F.col(customer_col).isNotNull())
                .groupBy(customer_col)
                .agg(F.collect_set(month_start(date_col)).alias("_months")))
    rows = months.select(F.array_min("_months").alias("_cohort"),
                         F.explode("_months").alias("_month"))
    out = (rows.groupBy("_cohort", "_month")
               .agg(F.count(F.lit(1)).alias("num_customers")))
    return out.select(
        month_text("_cohort").alias("cohort_month"),
        month_text("_month").alias("purchase_month"),
        months_crossed("_cohort", "_month").alias("months_since_first_purchase"),
        "num_customers")


# --------------------------------------------------------------------- RP2
def filtered_orders(mart: OrderMart, district_name: str = FILTER_DISTRICT, status: str = FILTER_STATUS,
                    payment_method: str = FILTER_PAYMENT, start=FILTER_PERIOD[0], end=FILTER_PERIOD[1],
                    as_written: bool = False) -> DataFrame:
    """Order ids of one district with a given status and payment in a period
    (the whole end day; ``as_written=True``: up to its midnight only, D5)."""
    o = mart.order_table
    o = o.where((F.col("order_status") == status) & (F.col("payment_method") == payment_method)
                & period_filter(o, "create_date", start, end, as_written=as_written))
    d = mart.dim("district_info").where(F.col("district_name") == district_name).select("district_id")
    return o.join(d, "district_id").select("order_id")


# --------------------------------------------------------------------- RP3
def share_leaders(mart: OrderMart, year: int = WALLET_MONTH[0], month: int = WALLET_MONTH[1],
                  wallet: str = WALLET_PAYMENT, as_written: bool = False, scale: int = 2) -> DataFrame:
    """City with the highest share of wallet orders in a month, and its top district.

    Default: shares are exact (D2) and names join on the district key (D1).
    ``as_written=True`` sums shares already rounded per district and joins
    district names on the city key only (one row per district of the city).
    """
    start, stop = month_range(year, month)
    o = mart.order_table
    o = o.where(period_filter(o, "create_date", start, stop, inclusive_end_day=False))
    g = (o.groupBy("city_id", "district_id")
          .agg(F.count("order_id").alias("n"),
               F.count(F.when(F.col("payment_method") == wallet, F.col("order_id"))).alias("w")))
    # city totals over all payments: a window over the (small) aggregated frame, no self-join
    per_city = Window.partitionBy("city_id")
    g = (g.withColumn("n_city", F.sum("n").over(per_city)).withColumn("w_city", F.sum("w").over(per_city))
          .where(F.col("w") > 0))
    g = g.withColumn("per_district_exact", F.try_divide(F.col("w").cast("decimal(20,0)"),
                                                        F.col("n").cast("decimal(20,0)")))
    if as_written:
        part = pct_rounded(F.col("w"), F.col("n_city"), scale, as_double=False)
        g = (g.withColumn("per_city_key", F.sum(part).over(per_city))
              .withColumn("per_city", F.col("per_city_key").cast("double")))
    else:
        g = (g.withColumn("per_city_key", F.try_divide(F.col("w_city").cast("decimal(20,0)"),
                                                       F.col("n_city").cast("decimal(20,0)")))
              .withColumn("per_city", pct_rounded(F.col("w_city"), F.col("n_city"), scale)))
    g = g.withColumn("per_district", pct_rounded(F.col("w"), F.col("n"), scale))
    district_key = "per_district" if as_written else "per_district_exact"
    best_city = top_ties(g, "per_city_key", descending=True)
    best = top_ties(best_city, district_key, descending=True, partition_by="city_id")
    cities = mart.dim("city_info")
    districts = mart.dim("district_info")
    if as_written:
        named = (best.select("city_id", "per_city", "per_district")
                     .join(districts.select("city_id", "district_name"), "city_id"))
    else:
        named = (best.select("city_id", "district_id", "per_city", "per_district")
                     .join(districts.select("district_id", "district_name"), "district_id"))
    return (named.join(cities, "city_id")
                 .select("city_name", "per_city", "district_name", "per_district"))


# --------------------------------------------------------------------- RP4
def keyword_monthly_sales(mart: OrderMart, keywords=MERCHANT_KEYWORDS, case_sensitive: bool = False,
                          by: str = "month", normalize: bool = True, by_id: bool = False) -> DataFrame:
    """Orders and sales per month for merchants whose name contains a keyword.

    The fact keeps only lines of matching merchants, is reduced to (merchant id,
    month) and then gets names and is re-grouped by name (names may repeat
    across ids, D19). ``by='year_month'`` keeps years apart (D18). Names and
    keywords are compared ignoring case and the Unicode form of accents (D6).
    ``by_id=True`` keeps merchants that share a name apart (D19).
    """
    merchants = (mart.dim("merchant_info")
                 .where(contains_text("merchant_name", list(keywords), case_sensitive, normalize)))
    # the filter comes first: on a derived order table the semi-join moves down to its line side
    o = mart.order_table.join(merchants.select("merchant_id"), "merchant_id", "left_semi")
    month = (F.month("create_date") if by == "month"
             else F.date_format(month_start("create_date"), "yyyy-MM"))
    per_id = (o.groupBy("merchant_id", month.alias("month"))
               .agg(F.count("order_id").alias("total_volume"),
                    F.sum("order_value_amount_usd").alias("total_sales")))
    names = ["merchant_id", "merchant_name"] if by_id else ["merchant_name"]
    out = (per_id.join(merchants, "merchant_id")
                 .groupBy(*names, "month")
                 .agg(F.sum("total_volume").alias("total_volume"),
                      F.sum("total_sales").cast("double").alias("total_sales")))
    return out.orderBy(F.col("month"), F.col("total_sales").desc(), F.col("total_volume").desc())


# --------------------------------------------------------------------- RP5
def conditional_share(mart: OrderMart, districts=DISTANCE_DISTRICTS,
                      max_distance: float = MAX_DISTANCE_KM, scale: int = 2, keep_zero: bool = True) -> DataFrame:
    """Percent of orders within ``max_distance`` per district, one pass (D3, D23).

    ``keep_zero=False`` drops districts without a hit, as an inner join of the
    two separate counts would."""
    d = mart.dim("district_info").where(F.col("district_name").isin(list(districts)))
    o = mart.order_table.join(d.select("district_id", "district_name"), "district_id")
    g = rate_where(o, ["district_id", "district_name"], F.col("order_distance") <= max_distance,
                   total_col="total_volume", hits_col="volume", pct_col="per_order", scale=scale,
                   count_of="order_id")
    if not keep_zero:
        g = g.where(F.col("volume") > 0)
    return g.select("district_name", "per_order")


# --------------------------------------------------------------------- RP6
def top_average_fee(mart: OrderMart, start=FEE_PERIOD[0], end=FEE_PERIOD[1], rate: int = VND_PER_USD,
                    scale: int = 1, as_written: bool = False, by_id: bool = False) -> DataFrame:
    """District with the highest average service fee in a period, converted by ``rate``
    (grouped by district name as asked; ``by_id=True`` by id and name, D19)."""
    o = mart.order_table
    o = o.where(period_filter(o, "create_date", start, end, as_written=as_written))
    per_id = (o.groupBy("district_id")
               .agg(F.sum("service_fee_usd").alias("s"), F.count("service_fee_usd").alias("c")))
    names = ["district_id", "district_name"] if by_id else ["district_name"]
    per_name = (per_id.join(mart.dim("district_info"), "district_id")
                      .groupBy(*names)
                      .agg(F.sum("s").alias("s"), F.sum("c").alias("c")))
    avg = F.try_divide(F.col("s"), F.col("c").cast("decimal(20,0)"))
    ranked = per_name.withColumn("_avg", avg)
    best = top_ties(ranked, "_avg", descending=True)
    return best.select(*names,
                       F.round(F.col("_avg") * F.lit(rate), scale).cast("double").alias("avg_service_fee_vnd"))


# --------------------------------------------------------------------- RP7
def _ranks_as_written(g: DataFrame, value: str, ranks) -> DataFrame:
    """``DENSE_RANK() OVER (ORDER BY value DESC) IN ranks`` on a small aggregated frame."""
    w = Window.orderBy(F.col(value).desc())
    return g.withColumn("_rank", F.dense_rank().over(w)).where(F.col("_rank").isin(list(ranks))).drop("_rank")


def busiest_weekdays(orders: DataFrame, date_col: str = "create_date", as_written: bool = False) -> DataFrame:
    """Weekday (Sunday = 1) with the most and with the fewest orders (D4).

    ``as_written=True`` keeps dense ranks 1 and 7, which misses the lowest day
    whenever two days tie."""
    g = orders.groupBy(weekday_sunday1(date_col).alias("day_of_week")).agg(F.count(F.lit(1)).alias("no_order"))
    return _ranks_as_written(g, "no_order", (1, 7)) if as_written else extremes(g, "no_order")


def busiest_hours(orders: DataFrame, time_col: str = "create_time", as_written: bool = False) -> DataFrame:
    """Hour of day with the most and with the fewest orders (D4).

    ``as_written=True`` keeps dense ranks 1 and 24 (see ``busiest_weekdays``)."""
    g = orders.groupBy(hour_of_day(time_col).alias("hour_of_day")).agg(F.count(F.lit(1)).alias("no_order"))
    return _ranks_as_written(g, "no_order", (1, 24)) if as_written else extremes(g, "no_order")


# --------------------------------------------------------------------- RP8
def top_merchant_by_segment(mart: OrderMart, cities=SEGMENT_CITIES, by_id: bool = False) -> DataFrame:
    """Highest-GMV merchant per (city, merchant segment), ties kept
    (merchants grouped by name as asked; ``by_id=True`` by id and name, D19)."""
    c = mart.dim("city_info").where(F.col("city_name").isin(list(cities)))
    o = mart.order_table.join(c, "city_id")
    per_id = o.groupBy("city_name", "merchant_id").agg(F.sum("gmv_usd").alias("gmv"))
    named = (per_id.join(mart.dim("merchant_segment"), "merchant_id")
                   .join(mart.dim("merchant_info"), "merchant_id")
                   .where(F.col("merchant_segment").isNotNull())
                   .groupBy("city_name", "merchant_segment", *(["merchant_id"] if by_id else []), "merchant_name")
                   .agg(F.sum("gmv").alias("gmv")))
    best = top_ties(named, "gmv", descending=True, partition_by=["city_name", "merchant_segment"])
    return best.select("city_name", "merchant_segment", *(["merchant_id"] if by_id else []), "merchant_name",
                       F.col("gmv").cast("double").alias("gmv"))


# --------------------------------------------------------------------- RP9
def one_time_buyer_rate(mart: OrderMart, city: str = RETURN_CITY, year: int = RETURN_MONTH[0],
                        month: int = RETURN_MONTH[1], scale: int = 2, keep_zero: bool = True,
                        by_id: bool = False) -> DataFrame:
    """Per merchant name: buyers, buyers with exactly one order, and their percent.

    Two reductions: (merchant, user) order counts, then per merchant
    ``count_if(n = 1)`` and ``count(*)`` in one pass; merchants whose buyers all
    returned keep a 0 % row (D3; ``keep_zero=False`` drops them, as the inner
    join of the source question does). NULL users are not buyers (D20).
    Merchants are grouped by name as asked; ``by_id=True`` by id and name (D19).
    """
    start, stop = month_range(year, month)
    c = mart.dim("city_info").where(F.col("city_name") == city).select("city_id")
    o = mart.order_table
    o = (o.where(period_filter(o, "create_date", start, stop, inclusive_end_day=False)
                 & F.col("user_id").isNotNull())
          .join(c, "city_id"))
    per_id = o.groupBy("merchant_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    names = ["merchant_id", "merchant_name"] if by_id else ["merchant_name"]
    per_name = (per_id.join(mart.dim("merchant_info"), "merchant_id")
                      .groupBy(*names, "user_id").agg(F.sum("n").alias("n")))
    g = (per_name.groupBy(*names)
                 .agg(F.count(F.lit(1)).alias("buyers"), F.count_if(F.col("n") == 1).alias("one_time_buyers")))
    if not keep_zero:
        g = g.where(F.col("one_time_buyers") > 0)
    return g.select(*names, "buyers", "one_time_buyers",
                    pct_rounded(F.col("one_time_buyers"), F.col("buyers"), scale).alias("one_time_pct"),
                    F.try_divide(F.col("one_time_buyers").cast("decimal(20,0)"),
                                 F.col("buyers").cast("decimal(20,0)")).alias("_share"))


def return_rate_leaders(mart: OrderMart, city: str = RETURN_CITY, year: int = RETURN_MONTH[0],
                        month: int = RETURN_MONTH[1], scale: int = 2, keep_zero: bool = True,
                        by_id: bool = False) -> DataFrame:
    """Merchant(s) with the lowest share of one-time buyers (highest return rate)."""
    g = one_time_buyer_rate(mart, city, year, month, scale, keep_zero, by_id)
    names = ["merchant_id", "merchant_name"] if by_id else ["merchant_name"]
    return top_ties(g, "_share", descending=False).select(*names, "one_time_pct")


# --------------------------------------------------------------------- RP10
def cancel_rate_leaders(mart: OrderMart, city_ids=CANCEL_CITY_IDS, start=CANCEL_PERIOD[0],
                        end=CANCEL_PERIOD[1], cancel_status: str = CANCEL_STATUS, scale: int = 2,
                        keep_zero: bool = True, as_written: bool = False, by_id: bool = False) -> DataFrame:
    """District with the highest cancel rate among orders of some cities in a period
    (``keep_zero=False`` drops districts without a cancellation, D3; ``as_written``
    ends the period at midnight of the end day, D5)."""
    o = mart.order_table
    o = o.where(F.col("city_id").isin([int(x) for x in city_ids])
                & period_filter(o, "create_date", start, end, as_written=as_written))
    per_id = (o.groupBy("district_id")
               .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("order_status") == cancel_status).alias("c")))
    names = ["district_id", "district_name"] if by_id else ["district_name"]
    per_name = (per_id.join(mart.dim("district_info"), "district_id", "left")
                      .where(F.col("district_name").isNotNull())
                      .groupBy(*names).agg(F.sum("n").alias("n"), F.sum("c").alias("c")))
    if not keep_zero:
        per_name = per_name.where(F.col("c") > 0)
    ranked = per_name.withColumn("_rate", F.try_divide(F.col("c").cast("decimal(20,0)"),
                                                       F.col("n").cast("decimal(20,0)")))
    best = top_ties(ranked, "_rate", descending=True)
    return best.select(*names, pct_rounded(F.col("c"), F.col("n"), scale).alias("cancel_rate"))


# --------------------------------------------------------------------- RP11
def value_band_pivot(mart: OrderMart, bands=ORDER_VALUE_BANDS, top=ORDER_VALUE_TOP,
                     amount_col: str = "order_value_amount_usd") -> DataFrame:
    """Orders per value band (amount x exchange rate), one row per city, one column per band.

    Cities without a name (unmatched id) stay as a NULL row, like a LEFT JOIN.
    """
    o = mart.order_table
    value = F.col(amount_col) * F.col("exchange_rate")
    per_id = (o.groupBy("city_id", band(value, bands, top).alias("order_range"))
               .agg(F.count(F.lit(1)).alias("volume")))
    named = per_id.join(mart.dim("city_info"), "city_id", "left")
    labels = band_labels(bands, top)
    wide = pivot_counts(named, "city_name", "order_range", labels, "volume")
    return wide.orderBy(*[F.col(f"`{lab}`").desc_nulls_last() for lab in labels])


# --------------------------------------------------------------------- RP12
def value_band_cancel(mart: OrderMart, bands=GMV_BANDS, top=GMV_TOP, cancel_status: str = CANCEL_STATUS,
                      amount_col: str = "gmv_usd") -> DataFrame:
    """Orders, distinct cancelled orders and their ratio per (city name, GMV band).

    The name is joined first, so an order that occurs under two ids of one city
    name is one cancelled order; cities without a name are left out.
    """
    cities = mart.dim("city_info").where(F.col("city_name").isNotNull())
    named = mart.order_table.join(cities, "city_id")
    value = F.col(amount_col) * F.col("exchange_rate")
    cancelled = F.when(F.col("order_status") == cancel_status, F.col("order_id"))
    return (named.groupBy("city_name", band(value, bands, top).alias("gmv_range"))
                 .agg(F.count("order_id").alias("total_net_orders"),
                      F.count_distinct(cancelled).alias("cancel_orders"))
                 .withColumn("cancel_orders_ratio", safe_ratio("cancel_orders", "total_net_orders"))
                 .orderBy("city_name", "gmv_range"))
