"""Edge cases on tiny literal frames (decisions D1-D24 of the blueprint)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import collect_rows

from bizlens.functions.bands import GMV_BANDS, GMV_TOP, ORDER_VALUE_BANDS, ORDER_VALUE_TOP, band
from bizlens.functions.periods import in_period, months_crossed
from bizlens.functions.ratios import pct_rounded, round_decimal
from bizlens.operators import clean, distributions, features, profile
from bizlens.operators.ranking import extremes, top_ties
from bizlens.plans import orders as rp
from bizlens.sources.mart import OrderMart


def test_months_crossed_counts_boundaries(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 31), dt.date(2021, 2, 1)),
                                (dt.date(2021, 12, 1), dt.date(2022, 1, 31))], "a date, b date")
    assert [r[0] for r in df.select(months_crossed("a", "b")).collect()] == [1, 1]


def test_in_period_keeps_whole_last_day(spark):
    df = spark.createDataFrame([(dt.datetime(2022, 7, 31, 10, 0),), (dt.datetime(2022, 8, 1, 0, 0),)],
                               "t timestamp_ntz")
    got = df.where(in_period("t", "2022-07-01", "2022-07-31")).count()
    assert got == 1


def test_cohort_ignores_null_dates_and_customers(spark):
    rows = [(1, dt.datetime(2021, 1, 31)), (1, dt.datetime(2021, 2, 1)), (1, None),
            (None, dt.datetime(2021, 1, 5)), (2, dt.datetime(2021, 12, 3)), (2, dt.datetime(2022, 1, 2))]
    df = spark.createDataFrame(rows, "CustomerID bigint, InvoiceDate timestamp_ntz")
    got = sorted(tuple(r) for r in rp.cohort_retention(df).collect())
    assert got == [("2021-01-01", "2021-01-01", 0, 1), ("2021-01-01", "2021-02-01", 1, 1),
                   ("2021-12-01", "2021-12-01", 0, 1), ("2021-12-01", "2022-01-01", 1, 1)]


@pytest.mark.parametrize("value,left,right", [
    (Decimal("0"), "0-50K", "1. 0-50k"),
    (Decimal("49999.99"), "0-50K", "1. 0-50k"),
    (Decimal("50000"), "50K-100K", "1. 0-50k"),
    (Decimal("100000"), "50K-100K", "2. 50-100k"),
    (Decimal("600000"), "400K-600K", "5. 400-600k"),
    (Decimal("600000.01"), ">600K", "6. Above 600k"),
    (None, ">600K", "6. Above 600k"),
])
def test_band_edges(spark, value, left, right):
    df = spark.createDataFrame([(value,)], "x decimal(18,2)")
    r = df.select(band("x", ORDER_VALUE_BANDS, ORDER_VALUE_TOP).alias("a"),
                  band("x", GMV_BANDS, GMV_TOP).alias("b")).first()
    assert (r["a"], r["b"]) == (left, right)


def test_rounding_is_half_up_on_decimals(spark):
    df = spark.createDataFrame([(2469, 20000), (1, 8), (1, 160)], "n long, d long")
    got = [r[0] for r in df.select(pct_rounded("n", "d", 2)).collect()]
    assert got == [12.35, 12.5, 0.63]
    one = spark.createDataFrame([(1.005,)], "x double").select(round_decimal("x", 2)).first()[0]
    assert one == 1.01


def test_extremes_keep_lowest_with_ties(spark):
    df = spark.createDataFrame([(1, 10), (2, 10), (3, 7), (4, 3), (5, 3)], "k int, n int")
    assert sorted(r["k"] for r in extremes(df, "n").collect()) == [1, 2, 4, 5]


def test_top_ties_per_group_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 4, None), ("b", 5, 2.0)],
                               "g string, k int, v double")
    got = sorted(r["k"] for r in top_ties(df, "v", partition_by="g").collect())
    assert got == [1, 2, 5]
    assert sorted(r["k"] for r in top_ties(df, "v", descending=False).collect()) == [3]


def _mini_mart(spark):
    orders = spark.createDataFrame([
        (1, 10, 100, 1, 1, dt.datetime(2022, 5, 3), "cancel", "Cash", 2.0, Decimal("10.00"), Decimal("1.0000"),
         Decimal("10.00"), Decimal("1.5")),
        (2, 11, 100, 1, 1, dt.datetime(2022, 5, 31, 22, 0), "delivered", "E-Wallet", 5.0, Decimal("20.00"),
         Decimal("2.0000"), Decimal("20.00"), Decimal("1.5")),
        (3, 12, 101, 2, 1, dt.datetime(2022, 5, 4), "delivered", "Cash", 1.0, Decimal("30.00"), Decimal("3.0000"),
         Decimal("30.00"), Decimal("1.5")),
        (4, 12, 101, 2, 1, dt.datetime(2022, 5, 5), "delivered", "Cash", 1.0, Decimal("30.00"), Decimal("3.0000"),
         Decimal("30.00"), Decimal("1.5")),
        (5, None, 101, 3, 2, dt.datetime(2022, 5, 5), "cancel", "Cash", 9.0, Decimal("30.00"), Decimal("3.0000"),
         Decimal("30.00"), Decimal("1.5")),
    ], "order_id long, user_id long, merchant_id long, district_id long, city_id long, create_date timestamp_ntz, "
       "order_status string, payment_method string, order_distance double, order_value_amount_usd decimal(18,2), "
       "service_fee_usd decimal(18,4), gmv_usd decimal(18,2), exchange_rate decimal(18,4)")
    districts = spark.createDataFrame([(1, "D1", 1), (2, "D2", 1), (3, "D3", 2)],
                                      "district_id long, district_name string, city_id long")
    cities = spark.createDataFrame([(1, "C1"), (2, "C2")], "city_id long, city_name string")
    # merchant 100 is stored with decomposed accents (a + combining acute, i + combining grave)
    merchants = spark.createDataFrame([(100, "Ba\u0301nh Mi\u0300 X"), (101, "xôi Y")],
                                      "merchant_id long, merchant_name string")
    segs = spark.createDataFrame([(100, "S"), (101, None)], "merchant_id long, merchant_segment string")
    return OrderMart(orders, districts, cities, merchants, segs)


def test_zero_rate_groups_are_kept(spark):
    m = _mini_mart(spark)
    got = {r["district_name"]: r["per_order"] for r in
           rp.conditional_share(m, districts=("D1", "D2", "D3"), max_distance=1.0).collect()}
    assert got == {"D1": 0.0, "D2": 100.0, "D3": 0.0}


def test_last_day_after_midnight_is_in_period(spark):
    m = _mini_mart(spark)
    got = rp.filtered_orders(m, "D1", "delivered", "E-Wallet", "2022-05-01", "2022-05-31")
    assert [r[0] for r in got.collect()] == [2]


def test_all_returning_merchant_wins(spark):
    m = _mini_mart(spark)
    got = collect_rows(rp.return_rate_leaders(m, city="C1", year=2022, month=5))
    assert got == [{"merchant_name": "xôi Y", "one_time_pct": 0.0}]


def test_keyword_case_insensitive(spark):
    m = _mini_mart(spark)
    got = {r["merchant_name"] for r in rp.keyword_monthly_sales(m, keywords=("bánh mì", "XÔI")).collect()}
    assert got == {"Ba\u0301nh Mi\u0300 X", "xôi Y"}
    plain = {r["merchant_name"] for r in
             rp.keyword_monthly_sales(m, keywords=("bánh mì", "XÔI"), normalize=False).collect()}
    assert plain == {"xôi Y"}


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (None, 5.0)], "a double, b double")
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in profile.correlation(df).collect()}
    assert got[("a", "b")] is None and got[("a", "a")] == 1.0


def test_strip_currency_strict_and_lenient(spark):
    df = spark.createDataFrame([("R$ 1637.94",), ("R$ 1,2",)], "claim_amount string")
    assert clean.strip_currency(df, "claim_amount", lenient=True).collect()[1][0] is None
    with pytest.raises(Exception):
        clean.strip_currency(df, "claim_amount").collect()


def test_cause_spellings_collapse(spark):
    df = spark.createDataFrame([(" Meat",), ("VEGETABLES",), ("meat",), ("unknown",), ("vegetable",),
                                ("red meat",)], "cause string")
    got = [r[0] for r in clean.normalise_category(df, "cause").collect()]
    assert got == ["meat", "vegetable", "meat", "unknown", "vegetable", "redmeat"]


def test_fill_mean_and_constant(spark):
    df = spark.createDataFrame([(1.0, True), (None, None), (3.0, False)], "x double, f boolean")
    out = clean.fill_value(clean.fill_mean(df, "x", exact_scale=2), "f", False).collect()
    assert [r["x"] for r in out] == [1.0, 2.0, 3.0] and [r["f"] for r in out] == [True, False, False]


def test_histogram_top_edge_in_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 10]], "x double")
    h = {r["bin"]: r["n"] for r in distributions.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 0, 3: 0, 4: 1}


def test_ansi_error_surface(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([("x",)], "s string").select(F.col("s").cast("int")).collect()


def test_share_leaders_default_and_as_written(spark):
    m = _mini_mart(spark)
    ours = collect_rows(rp.share_leaders(m, year=2022, month=5, wallet="E-Wallet"))
    assert ours == [{"city_name": "C1", "per_city": 25.0, "district_name": "D1", "per_district": 50.0}]
    written = collect_rows(rp.share_leaders(m, year=2022, month=5, wallet="E-Wallet", as_written=True))
    # D1: names joined on the city only -> one row per district of the winning city
    assert sorted(r["district_name"] for r in written) == ["D1", "D2"]
    assert {r["per_city"] for r in written} == {25.0}


def test_names_merge_ids_when_grouping_by_name(spark):
    m = _mini_mart(spark)
    dup = spark.createDataFrame([(1, "Same", 1), (2, "Same", 1), (3, "D3", 2)],
                                "district_id long, district_name string, city_id long")
    m2 = OrderMart(m.order_table, dup, m.city_info, m.merchant_info, m.merchant_segment)
    got = collect_rows(rp.cancel_rate_leaders(m2, city_ids=(1, 2), start="2022-05-01", end="2022-05-31"))
    # D19: both ids named "Same" form one group (1 cancel of 4) vs D3 (1 of 1)
    assert got == [{"district_name": "D3", "cancel_rate": 100.0}]


def test_value_band_pivot_keeps_unmatched_city(spark):
    m = _mini_mart(spark)
    cities = spark.createDataFrame([(1, "C1")], "city_id long, city_name string")
    m2 = OrderMart(m.order_table, m.district_info, cities, m.merchant_info, m.merchant_segment)
    rows = {r["city_name"]: r for r in rp.value_band_pivot(m2).collect()}
    assert set(rows) == {"C1", None}
    assert rows[None]["0-50K"] == 1 and rows[None][">600K"] is None


def test_small_helpers(spark):
    from bizlens.functions.bands import band_ordinal
    from bizlens.functions.ratios import ratio_rounded
    from bizlens.operators.aggregate import rate_where
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 7)], "g string, v int")
    got = {r["g"]: (r["total"], r["hits"], r["pct"]) for r in rate_where(df, "g", F.col("v") > 3).collect()}
    assert got == {"a": (2, 1, 50.0), "b": (1, 1, 100.0)}
    r = spark.createDataFrame([(1, 3)], "n long, d long").select(ratio_rounded("n", "d", 4)).first()[0]
    assert r == 0.3333
    lab = spark.createDataFrame([(">600K",), ("0-50K",)], "b string")
    assert [x[0] for x in lab.select(band_ordinal("b", ORDER_VALUE_BANDS, ORDER_VALUE_TOP)).collect()] == [6, 1]
    cum = distributions.cumulative(spark.createDataFrame([(1, 0.5), (2, 0.25)], "k int, r double"), "k", "r")
    assert [x["cumulative"] for x in cum.orderBy("k").collect()] == [0.5, 0.75]


def test_period_bounds_ignore_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2022, 7, 1, 0, 30),), (dt.datetime(2022, 6, 30, 23, 30),)],
                               "t timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert df.where(in_period("t", "2022-07-01", "2022-07-31")).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_as_written_options(spark):
    m = _mini_mart(spark)
    got = {r["district_name"] for r in
           rp.conditional_share(m, districts=("D1", "D2", "D3"), max_distance=1.0, keep_zero=False).collect()}
    assert got == {"D2"}
    assert rp.return_rate_leaders(m, city="C1", year=2022, month=5, keep_zero=False).count() == 1
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in [1, 1, 2, 2, 3, 4, 5, 6, 7, 7, 7]],
                                 "create_date date")
    ours = sorted(r["day_of_week"] for r in rp.busiest_weekdays(days).collect())
    written = sorted(r["day_of_week"] for r in rp.busiest_weekdays(days, as_written=True).collect())
    # 2024-01-07 is a Sunday (1): 3 orders; four weekdays tie at the minimum (1), dense ranks stop at 3
    assert ours == [1, 4, 5, 6, 7] and written == [1]


def test_between_as_written_drops_last_day_after_midnight(spark):
    m = _mini_mart(spark)
    assert rp.filtered_orders(m, "D1", "delivered", "E-Wallet", "2022-05-01", "2022-05-31",
                              as_written=True).count() == 0


def test_by_id_keeps_equal_names_apart(spark):
    m = _mini_mart(spark)
    dup = spark.createDataFrame([(1, "Same", 1), (2, "Same", 1), (3, "D3", 2)],
                                "district_id long, district_name string, city_id long")
    m2 = OrderMart(m.order_table, dup, m.city_info, m.merchant_info, m.merchant_segment)
    got = collect_rows(rp.cancel_rate_leaders(m2, city_ids=(1, 2), start="2022-05-01", end="2022-05-31",
                                              by_id=True))
    assert got == [{"district_id": 3, "district_name": "D3", "cancel_rate": 100.0}]
    rows = rp.keyword_monthly_sales(m, keywords=("x", "y"), by_id=True).collect()
    assert {r["merchant_id"] for r in rows} == {100, 101}


def test_value_band_cancel_counts_an_order_once_per_city_name(spark):
    orders = spark.createDataFrame(
        [(1, 1, "CANCEL", 10.0, 1.0), (1, 2, "CANCEL", 10.0, 1.0), (2, 3, "CANCEL", 10.0, 1.0), (3, 1, "DONE", 700000.0, 1.0)],
        "order_id long, city_id long, order_status string, gmv_usd double, exchange_rate double")
    cities = spark.createDataFrame([(1, "Same"), (2, "Same"), (3, None)], "city_id long, city_name string")
    got = collect_rows(rp.value_band_cancel(OrderMart(orders, None, cities), cancel_status="CANCEL"))
    assert got == [
        {"city_name": "Same", "gmv_range": "1. 0-50k", "total_net_orders": 2, "cancel_orders": 1, "cancel_orders_ratio": 0.5},
        {"city_name": "Same", "gmv_range": "6. Above 600k", "total_net_orders": 1, "cancel_orders": 0, "cancel_orders_ratio": 0.0}]


def test_keyword_matches_either_form_of_accents_without_python(spark):
    import unicodedata

    from bizlens.functions.text import contains_text
    names = ["BÁNH MÌ 24h", unicodedata.normalize("NFD", "bánh mì"), "banh mi", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    hit = df.where(contains_text("n", ["bánh mì"], normalize=True))
    assert {r["i"] for r in hit.collect()} == {0, 1}
    assert "Python" not in hit._jdf.queryExecution().executedPlan().toString()


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (3.0,)], "x double")
    row = profile.describe(df, ["x"]).first()
    assert (row["count"], row["mean"], row["max"], row["q5" if "q5" in row else "q50"]) == (3, 2.0, 3.0, 2.0)
    assert [r["n"] for r in distributions.histogram(df, "x", 2).orderBy("bin").collect()] == [1, 2]


def test_equal_rows_are_sampled_independently(spark):
    from bizlens.sources import sample_rows
    df = spark.createDataFrame([(i % 4,) for i in range(1000)], "v int")
    assert len({r["v"] for r in sample_rows(df, 40).collect()}) == 4


def test_levels_with_dots(spark):
    df = spark.createDataFrame([("1.5", 1.0), ("2", 3.0)], "c string, x double")
    wide = features.one_hot(df, ["c"])
    assert wide.columns == ["x", "c_1.5", "c_2"]
    scaled = features.standardise(wide, ["c_1.5", "x"])
    assert features.assemble(scaled, ["c_1.5", "c_2", "x"]).count() == 2
    assert features.column_slice(wide, 1).columns == ["c_1.5", "c_2"]


def test_models_learn_the_bookings_target(spark):
    """Three models or more beat the majority class on the derived target, the forest among them."""
    from bizlens.plans import bookings as bk
    from bizlens.sources.mart import bookings_frame
    from bizlens.sources.tables import load_tables
    b = bookings_frame(load_tables(spark, "/root/testdata/sf0.01"))
    majority = max(r["count"] for r in b.groupBy("booking_status").count().collect()) / b.count()
    scores = {r["model"]: r for r in bk.cancellation_leaderboard(b, forest_trees=20, scale_features=True).collect()}
    better = [m for m, r in scores.items() if r["accuracy"] > majority + 0.03 and r["f1"] > 0]
    assert len(better) >= 3 and "Random forest" in better
