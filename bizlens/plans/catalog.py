"""Query catalogue: every report and operator, bound to the star-schema tables.

``QUERIES[name](spark, base_dir)`` returns a DataFrame; the mapping from the
test tables to the report inputs lives in :mod:`bizlens.sources.mart`.
Parameters are chosen so each question has an answer on those tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.functions.bands import band
from bizlens.operators import aggregate as agg
from bizlens.operators import classify as ml
from bizlens.operators import clean as cl
from bizlens.operators import distributions as ds
from bizlens.operators import features as fe
from bizlens.operators import profile as pr
from bizlens.operators import scan as sc
from bizlens.operators import segments as sg
from bizlens.plans import bookings as bk
from bizlens.plans import claims as cr
from bizlens.plans import orders as rp
from bizlens.session import materialise
from bizlens.sources.mart import (CANCEL_STATUS, bookings_frame, claims_frame, events_as_orders, lines_mart,
                                  order_facts, orders_mart)
from bizlens.sources.samples import head_rows, sample_by, sample_per_group, sample_rows, tail_rows
from bizlens.sources.tables import load_tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark, base):
    return load_tables(spark, base)


# ------------------------------------------------------------- order reports
@register("cohort_retention")
def q_cohort_retention(spark, base):
    # only user and date are needed: no dimension join
    return rp.cohort_retention(order_facts(_t(spark, base)), customer_col="user_id", date_col="create_date")


@register("filtered_orders")
def q_filtered_orders(spark, base):
    return rp.filtered_orders(orders_mart(_t(spark, base)), district_name="NATION_7", status=CANCEL_STATUS,
                              payment_method="1-URGENT", start="1998-01-01", end="1998-12-31")


@register("share_leaders")
def q_share_leaders(spark, base):
    return rp.share_leaders(orders_mart(_t(spark, base)), year=1998, month=7, wallet="5-LOW")


@register("share_leaders_as_written")
def q_share_leaders_as_written(spark, base):
    return rp.share_leaders(orders_mart(_t(spark, base)), year=1998, month=7, wallet="5-LOW", as_written=True)


@register("keyword_monthly_sales")
def q_keyword_monthly_sales(spark, base):
    # merchant and month only: no customer join
    return rp.keyword_monthly_sales(lines_mart(_t(spark, base), with_geo=False), keywords=("Widget", "Bolt"))


@register("conditional_share")
def q_conditional_share(spark, base):
    return rp.conditional_share(lines_mart(_t(spark, base)), districts=("NATION_3", "NATION_7"), max_distance=3)


@register("top_average_fee")
def q_top_average_fee(spark, base):
    return rp.top_average_fee(lines_mart(_t(spark, base)), start="1998-06-01", end="1998-12-31")


@register("busiest_weekdays")
def q_busiest_weekdays(spark, base):
    return rp.busiest_weekdays(order_facts(_t(spark, base)), "create_date")


@register("busiest_weekdays_as_written")
def q_busiest_weekdays_as_written(spark, base):
    return rp.busiest_weekdays(order_facts(_t(spark, base)), "create_date", as_written=True)


@register("busiest_hours_as_written")
def q_busiest_hours_as_written(spark, base):
    return rp.busiest_hours(events_as_orders(_t(spark, base)), "create_time", as_written=True)


@register("busiest_hours")
def q_busiest_hours(spark, base):
    return rp.busiest_hours(events_as_orders(_t(spark, base)), "create_time")


@register("top_merchant_by_segment")
def q_top_merchant_by_segment(spark, base):
    return rp.top_merchant_by_segment(lines_mart(_t(spark, base)), cities=("ASIA", "EUROPE"))


@register("one_time_buyer_rate")
def q_one_time_buyer_rate(spark, base):
    m = lines_mart(_t(spark, base), merchant_name_from="p_brand")
    return rp.one_time_buyer_rate(m, city="ASIA", year=1998, month=7).drop("_share")


@register("return_rate_leaders")
def q_return_rate_leaders(spark, base):
    m = lines_mart(_t(spark, base), merchant_name_from="p_brand")
    return rp.return_rate_leaders(m, city="ASIA", year=1998, month=7)


@register("cancel_rate_leaders")
def q_cancel_rate_leaders(spark, base):
    return rp.cancel_rate_leaders(orders_mart(_t(spark, base)), city_ids=(0, 2), start="1998-05-01",
                                  end="1998-05-31", cancel_status=CANCEL_STATUS)


@register("value_band_pivot")
def q_value_band_pivot(spark, base):
    return rp.value_band_pivot(orders_mart(_t(spark, base)))


@register("value_band_cancel")
def q_value_band_cancel(spark, base):
    return rp.value_band_cancel(lines_mart(_t(spark, base)), cancel_status=CANCEL_STATUS)


@register("order_value_band_cancel")
def q_order_value_band_cancel(spark, base):
    """The same on whole orders, at a rate at which all six bands are filled."""
    m = orders_mart(_t(spark, base))
    m = replace(m, order_table=m.order_table.withColumn("exchange_rate", F.lit("2.5").cast("decimal(4,2)")))
    return rp.value_band_cancel(m, cancel_status=CANCEL_STATUS, amount_col="order_value_amount_usd")


# ---------------------------------------------------- profiling and cleaning


def _claims(spark, base):
    return claims_frame(_t(spark, base))


@register("status_share")
def q_status_share(spark, base):
    return agg.share_of_total(_t(spark, base)["orders"], "o_orderstatus", "n", "pct")


@register("null_counts")
def q_null_counts(spark, base):
    return pr.null_counts(_claims(spark, base))


@register("distinct_counts")
def q_distinct_counts(spark, base):
    return pr.distinct_counts(_t(spark, base)["orders"], ["o_orderstatus", "o_custkey", "o_orderpriority"])


@register("schema_report")
def q_schema_report(spark, base):
    return pr.schema_report(_claims(spark, base))


@register("quality_rules")
def q_quality_rules(spark, base):
    return cr.claims_rules(_claims(spark, base), ["AFRICA", "AMERICA", "ASIA", "EUROPE"])


@register("strip_currency")
def q_strip_currency(spark, base):
    df = cl.strip_currency(_claims(spark, base), "claim_amount")
    return df.select("claim_id", F.col("claim_amount").cast("double").alias("claim_amount"))


@register("normalise_category")
def q_normalise_category(spark, base):
    df = cl.normalise_category(_claims(spark, base), "cause")
    return df.groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


@register("impute_mean")
def q_impute_mean(spark, base):
    df = cl.fill_mean(_claims(spark, base), "amount_paid", exact_scale=3)
    return df.select("claim_id", "amount_paid")


@register("clean_claims")
def q_clean_claims(spark, base):
    df = cr.clean_claims(_claims(spark, base))
    return df.withColumn("claim_amount", F.col("claim_amount").cast("double"))


@register("describe")
def q_describe(spark, base):
    return pr.describe(_t(spark, base)["lineitem"], ["l_quantity", "l_extendedprice", "l_discount"])


@register("category_counts")
def q_category_counts(spark, base):
    return pr.category_counts(_t(spark, base)["orders"], ["o_orderstatus", "o_orderpriority"])


@register("correlation")
def q_correlation(spark, base):
    return pr.correlation(_t(spark, base)["lineitem"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register("histogram_50")
def q_histogram_50(spark, base):
    return ds.histogram(_t(spark, base)["orders"], "o_totalprice", 50)


@register("histogram_by_category")
def q_histogram_by_category(spark, base):
    t = _t(spark, base)
    o = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    return ds.binned_counts(o.select(F.month("o_orderdate").alias("month"),
                                     F.col("c_mktsegment").alias("segment")), ["month", "segment"])


@register("box_stats")
def q_box_stats(spark, base):
    df = cl.strip_currency(_claims(spark, base), "claim_amount")
    return ds.box_stats(df, "claim_amount", "location")


@register("outlier_cut")
def q_outlier_cut(spark, base):
    li = _t(spark, base)["lineitem"]
    return cl.cut_above(li, "l_quantity", 35).select("l_orderkey", "l_linenumber", "l_quantity")


@register("binned_2d")
def q_binned_2d(spark, base):
    return ds.binned_2d(_t(spark, base)["lineitem"], "l_quantity", "l_extendedprice", 5, 10000, by="l_returnflag")


@register("density_2d")
def q_density_2d(spark, base):
    b = ds.binned_2d(_t(spark, base)["lineitem"], "l_quantity", "l_extendedprice", 5, 10000, by="l_returnflag")
    d = ds.smoothed_density(b, bandwidth_bins=1.0, by="l_returnflag")
    return d.withColumn("density", F.round(F.col("density"), 12))


@register("claims_by_location")
def q_claims_by_location(spark, base):
    return cr.claims_by_location(cr.clean_claims(_claims(spark, base)))


@register("claims_time_histogram")
def q_claims_time_histogram(spark, base):
    return cr.time_to_close_histogram(cr.clean_claims(_claims(spark, base)))


@register("claims_boxes_after_cut")
def q_claims_boxes_after_cut(spark, base):
    return cr.time_to_close_boxes(cr.clean_claims(_claims(spark, base)), cut_below=120)


@register("claims_tail")
def q_claims_tail(spark, base):
    df = cl.cut_above(cr.clean_claims(_claims(spark, base)), "time_to_close", 120)
    return tail_rows(df.select("claim_id", "time_to_close", "location"), 10, "claim_id")


@register("claims_sample")
def q_claims_sample(spark, base):
    return sample_rows(cr.clean_claims(_claims(spark, base)), 10, seed=42, key="claim_id") \
        .withColumn("claim_amount", F.col("claim_amount").cast("double"))


# ------------------------------------------------- features and models


def _bookings(spark, base):
    return bookings_frame(_t(spark, base))


def _segment_report(spark, base):
    return bk.booking_segments(_bookings(spark, base))


@register("one_hot")
def q_one_hot(spark, base):
    return fe.one_hot(_t(spark, base)["orders"].select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@register("label_encode")
def q_label_encode(spark, base):
    return fe.label_encode(_t(spark, base)["part"].select("p_partkey", "p_brand"), ["p_brand"])


@register("standardise")
def q_standardise(spark, base):
    li = _t(spark, base)["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity")
    return fe.standardise(li, ["l_quantity"], digits=4, suffix="_z").drop("l_quantity")


@register("hash_split")
def q_hash_split(spark, base):
    e = _t(spark, base)["embeddings"]
    return e.select("vec_id", fe.split_flag("vec_id", 0.3, method="modulo").alias("split"))


def _embedding_split(spark, base):
    e = _t(spark, base)["embeddings"].withColumn("_split", fe.split_flag("vec_id", 0.3, method="modulo"))
    train = e.where(F.col("_split") == "train").select("vec_id", "embedding", "label")
    test = e.where(F.col("_split") == "test").select("vec_id", "embedding", "label")
    return train, test


@register("knn_vote")
def q_knn_vote(spark, base):
    train, test = _embedding_split(spark, base)
    pred = ml.knn_predict(train, test, 5, id_col="vec_id", vec_col="embedding", label_col="label")
    return pred.select("vec_id", "prediction")


def _doc_predictions(spark, base):
    t = _t(spark, base)
    return (t["documents"].join(t["labels"], "doc_id")
            .select("doc_id", F.col("quality").alias("label"),
                    (F.col("n_chars") > 1000).cast("int").alias("prediction")))


@register("binary_metrics")
def q_binary_metrics(spark, base):
    return ml.binary_metrics(_doc_predictions(spark, base), "label", "prediction", positive=1)


@register("confusion_matrix")
def q_confusion_matrix(spark, base):
    return ml.confusion(_doc_predictions(spark, base), "label", "prediction")


@register("naive_bayes_embeddings")
def q_naive_bayes_embeddings(spark, base):
    train, test = _embedding_split(spark, base)
    tr = train.select("vec_id", F.col("label").cast("double").alias("label"),
                      array_to_vector("embedding").alias("features"))
    te = test.select("vec_id", F.col("label").cast("double").alias("label"),
                     array_to_vector("embedding").alias("features"))
    model = ml.fit_naive_bayes(tr)
    return model.transform(te).select("vec_id", "label", "prediction")


@register("booking_pca_variance")
def q_booking_pca_variance(spark, base):
    return _segment_report(spark, base).pca_variance


@register("booking_elbow")
def q_booking_elbow(spark, base):
    return _segment_report(spark, base).elbow


@register("booking_segment_profile")
def q_booking_segment_profile(spark, base):
    return _segment_report(spark, base).profile


@register("booking_segment_target_mix")
def q_booking_segment_target_mix(spark, base):
    return _segment_report(spark, base).target_mix


@register("cancellation_leaderboard")
def q_cancellation_leaderboard(spark, base):
    rep = _segment_report(spark, base)
    return bk.cancellation_leaderboard(_bookings(spark, base), segment_ids=rep.segments,
                                       encoded=(rep.encoded, rep.feature_names))


@register("booking_pca_describe")
def q_booking_pca_describe(spark, base):
    seg = _segment_report(spark, base).segments
    return pr.describe(seg, ["col1", "col2"])


@register("booking_segment_sizes")
def q_booking_segment_sizes(spark, base):
    return _segment_report(spark, base).sizes


@register("table_shape")
def q_table_shape(spark, base):
    return pr.shape(_t(spark, base)["orders"])


@register("priority_value_counts")
def q_priority_value_counts(spark, base):
    return agg.value_counts(_t(spark, base)["orders"], "o_orderpriority", "n")


@register("stratified_sample")
def q_stratified_sample(spark, base):
    li = _t(spark, base)["lineitem"]
    pts = sample_by(li, "l_returnflag", {"A": 0.02, "N": 0.02, "R": 0.02}, seed=42)
    return pts.select("l_returnflag", "l_quantity", "l_extendedprice")


@register("booking_segment_density")
def q_booking_segment_density(spark, base):
    """DS6 per segment: smoothed density of (first principal component, room price)."""
    seg = _segment_report(spark, base).segments
    binned = ds.binned_2d(seg, "col1", bk.PRICE, 0.5, 10.0, by="Segment")
    return ds.smoothed_density(binned, bandwidth_bins=1.0, by="Segment")


# ------------------------------------- small operators on inputs that SQL can compute


@register("orders_head")
def q_orders_head(spark, base):
    """SC5: first rows by an explicit order."""
    o = _t(spark, base)["orders"].select("o_orderkey", "o_custkey", "o_orderstatus")
    return head_rows(o, 25, ["o_custkey", "o_orderkey"])


@register("priority_cumulative")
def q_priority_cumulative(spark, base):
    """AG13: running total over the few rows of a frequency table."""
    counts = agg.value_counts(_t(spark, base)["orders"], "o_orderpriority", "n")
    return ds.cumulative(counts, "o_orderpriority", "n")


def _banded_bookings(spark, base):
    """Bookings with a segment by price band instead of a fitted one."""
    return _banded(_bookings(spark, base))


def _banded(bookings):
    edges = [("low", 20000), ("middle", 60000)]
    b = bookings.withColumn("Segment", band(bk.PRICE, edges, "high"))
    return b.withColumn(bk.PRICE, F.col(bk.PRICE).cast("decimal(18,2)"))


@register("banded_segment_profile")
def q_banded_segment_profile(spark, base):
    """ML14/AG10: profile per segment."""
    out = sg.segment_profile(_banded_bookings(spark, base), "Segment", bk.PRICE, bk.TARGET)
    return out.withColumn("avg_price", F.round(F.col("avg_price").cast("double"), 3))


@register("banded_segment_mix")
def q_banded_segment_mix(spark, base):
    """ML14/AG11: target mix per segment."""
    return sg.segment_target_mix(_banded_bookings(spark, base), "Segment", bk.TARGET)


@register("rule_leaderboard")
def q_rule_leaderboard(spark, base):
    """ML13/SO5: scores of three rules, best first."""
    t = _t(spark, base)
    d = t["documents"].join(t["labels"], "doc_id").select(F.col("quality").alias("label"), "n_chars")
    rules = {"long": F.col("n_chars") > 1000, "short": F.col("n_chars") <= 500, "any": F.lit(True)}
    return ml.leaderboard([ml.binary_metrics(d.withColumn("prediction", c.cast("int")), model=name)
                           for name, c in rules.items()])


@register("mapped_status")
def q_mapped_status(spark, base):
    """CO6: value mapping, unmapped values missing."""
    return _t(spark, base)["orders"].select(
        "o_orderkey", cl.map_values("o_orderstatus", {"F": 1, "O": 0}).alias("closed"))


@register("aligned_columns")
def q_aligned_columns(spark, base):
    """JN7/PJ5: two frames put side by side on their key."""
    t = _t(spark, base)
    left = t["customer"].select(F.col("c_custkey").alias("key"), "c_mktsegment")
    counts = t["orders"].groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return fe.align(left, counts, "key")


@register("column_slice")
def q_column_slice(spark, base):
    """PJ7: columns by position."""
    return fe.column_slice(_t(spark, base)["orders"], 0, 3)


@register("order_running_total")
def q_order_running_total(spark, base):
    """AG13: running total over all orders by date, a row each."""
    o = _t(spark, base)["orders"].select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    out = ds.cumulative(o, ["o_orderdate", "o_orderkey"], "price", "total")
    return out.select("o_orderkey", F.col("total").cast("double").alias("total"))


def _customer_value(spark, base):
    return (_t(spark, base)["orders"].groupBy("o_custkey")
            .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value"), F.count(F.lit(1)).alias("n")))


@register("customer_ranks")
def q_customer_ranks(spark, base):
    """WN2: every customer's dense rank by number of orders (many ties) and rank by value, over all customers."""
    ranked = sc.global_rank(_customer_value(spark, base), "n", name="n_rank")
    ranked = sc.global_rank(ranked, "value", name="value_rank", dense=False)
    return ranked.select("o_custkey", "n", "n_rank", "value_rank")


@register("ranked_customers")
def q_ranked_customers(spark, base):
    """FI11: the customers whose rank by value is first, third or tenth."""
    top = sc.top_global(_customer_value(spark, base), "value", (1, 3, 10))
    return top.select("o_custkey", F.col("value").cast("double").alias("value"))


@register("side_by_side")
def q_side_by_side(spark, base):
    """PJ6: customers and orders next to each other without a key, the shorter frame filled up."""
    t = _t(spark, base)
    return sc.side_by_side(t["customer"].select("c_custkey", "c_mktsegment"), t["orders"].select("o_orderkey", "o_orderpriority"),
                           "c_custkey", "o_orderkey")


@register("row_numbers")
def q_row_numbers(spark, base):
    """JN7: a gapless index over all lines, by price and key."""
    li = _t(spark, base)["lineitem"].select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sc.row_index(li, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"]).drop("l_extendedprice")


@register("label_encode_columns")
def q_label_encode_columns(spark, base):
    """ML2: several columns at once, one of them with a level per row and one with missing values."""
    c = _t(spark, base)["customer"].select("c_custkey", "c_name", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"),
                                           F.col("c_nationkey").alias("nation"))
    return fe.label_encode(c, ["c_name", "segment", "nation"])


@register("one_hot_vector")
def q_one_hot_vector(spark, base):
    """ML1: sparse one-hot vectors of columns with many levels: their length and the places that are 1."""
    c = _t(spark, base)["customer"].select("c_custkey", "c_name", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"))
    out = fe.one_hot_vector(c, ["c_name", "segment"])
    return (out.select("c_custkey", fe.ones("features").alias("v"))
            .select("c_custkey", F.col("v.width").alias("width"), F.array_join(F.col("v.places").cast("array<string>"), ",").alias("places")))


@register("knn_all_rows")
def q_knn_all_rows(spark, base):
    """ML8/JN8: priority of every fifth order by the nearest of all other orders in price and date."""
    o = _t(spark, base)["orders"].select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("double").alias("label"),
        F.array((F.col("o_totalprice") / 100).cast("double"),
                F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")).alias("features"))
    test = F.col("o_orderkey") % 5 == 0
    pred = ml.knn_predict(o.where(~test), o.where(test), 5, id_col="o_orderkey", fit_rows=None)
    return pred.select("o_orderkey", "prediction")




@register("sample_per_category")
def q_sample_per_category(spark, base):
    """DS5/SC4: exactly 40 random orders of every status and priority."""
    o = _t(spark, base)["orders"].select("o_orderstatus", "o_orderpriority", "o_orderkey")
    return sample_per_group(o, ["o_orderstatus", "o_orderpriority"], 40, "o_orderkey", seed=7)


@register("correlation_with_missing")
def q_correlation_with_missing(spark, base):
    """PR5: pairwise complete rows, a constant column and one without values."""
    li = _t(spark, base)["lineitem"]
    missing = lambda c, m, r: F.when(F.col("l_orderkey") % m != r, F.col(c)).alias(c)
    df = li.select(missing("l_quantity", 3, 0), missing("l_extendedprice", 5, 1), missing("l_discount", 7, 2), "l_tax",
                   F.lit(4.5).alias("constant"), F.lit(None).cast("double").alias("nothing"))
    return pr.correlation(df)


@register("banded_profiles")
def q_banded_profiles(spark, base):
    """RP14/DS6: the eight profile columns against the price, smoothed per price band."""
    rows = materialise(_bookings(spark, base), "bookings")  # for the bands, the levels and the rows themselves
    out = bk.profile_densities(rows, _banded(rows), bins=12)
    return out.select("column", "Segment", "x_bin", "y_bin", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
                      F.round("density", 6).alias("density"))


@register("booking_profiles")
def q_booking_profiles(spark, base):
    """RP14: the same for the fitted segments."""
    return _segment_report(spark, base).profiles
