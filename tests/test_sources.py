"""CSV reading (SC2), samples (SC4-SC6) and sinks (SC7)."""

import os
import tempfile

from pyspark.sql import functions as F

from bizlens.sources import head_rows, read_csv, sample_rows, tail_rows, write_report


def test_csv_latin1_schema_no_unescape(spark):
    d = tempfile.mkdtemp(prefix="bizlens-csv-")
    path = os.path.join(d, "claims.csv")
    with open(path, "wb") as fh:
        fh.write("claim_id,claim_amount,location,cause\n".encode("latin-1"))
        fh.write("1,R$ 1637.94,SÃO LUIS,meat\\n\n".encode("latin-1"))
        fh.write("2,R$ 76106.80,RECIFE, Meat\n".encode("latin-1"))
    df = read_csv(spark, path, "claim_id int, claim_amount string, location string, cause string")
    rows = df.orderBy("claim_id").collect()
    assert rows[0]["location"] == "SÃO LUIS"
    assert rows[0]["cause"] == "meat\\n"
    assert rows[1]["cause"] == " Meat"


def test_head_tail_sample(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert [r["id"] for r in head_rows(df, 3, "id").collect()] == [0, 1, 2]
    assert [r["id"] for r in tail_rows(df, 3, "id").collect()] == [97, 98, 99]
    a = sorted(r["id"] for r in sample_rows(df, 10, seed=1, key="id").collect())
    b = sorted(r["id"] for r in sample_rows(df.repartition(7), 10, seed=1, key="id").collect())
    assert len(a) == 10 and a == b


def test_write_report_roundtrip(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="bizlens-out-"), "r")
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    write_report(df, out, partition_by=["g"])
    assert spark.read.parquet(out).count() == 10


def _bookings_csv(path, n=120):
    import random
    rnd = random.Random(5)
    header = ("Booking_ID,no_of_adults,no_of_children,no_of_weekend_nights,no_of_week_nights,type_of_meal_plan,"
              "required_car_parking_space,room_type_reserved,lead_time,arrival_year,arrival_month,arrival_date,"
              "market_segment_type,repeated_guest,no_of_previous_cancellations,"
              "no_of_previous_bookings_not_canceled,avg_price_per_room,no_of_special_requests,booking_status\n")
    with open(path, "w", encoding="latin-1") as fh:
        fh.write(header)
        for i in range(n):
            cancel = i % 3 == 0
            lead = rnd.randint(150, 300) if cancel else rnd.randint(0, 60)
            fh.write(f"INN{i:05d},{rnd.randint(1, 3)},{rnd.randint(0, 2)},{rnd.randint(0, 2)},{rnd.randint(1, 5)},"
                     f"Meal Plan {rnd.randint(1, 2)},0,Room_Type {rnd.randint(1, 3)},{lead},2018,{rnd.randint(1, 12)},"
                     f"{rnd.randint(1, 28)},{rnd.choice(['Online', 'Offline'])},0,0,0,"
                     f"{rnd.uniform(60, 160):.2f},{rnd.randint(0, 2)},{'Canceled' if cancel else 'Not_Canceled'}\n")


def test_bookings_csv_pipeline(spark):
    from bizlens.plans import bookings as bk
    from bizlens.sources import read_bookings_csv
    d = tempfile.mkdtemp(prefix="bizlens-bookings-")
    path = os.path.join(d, "bookings.csv")
    _bookings_csv(path)
    b = read_bookings_csv(spark, path)
    assert len(b.columns) == 19 and b.count() == 120
    rep = bk.booking_segments(b, ks=range(2, 5), micro_clusters=12, cols=bk.CSV_COLUMNS)
    assert sum(r["n"] for r in rep.sizes.collect()) == 120
    board = bk.cancellation_leaderboard(b, segment_ids=rep.segments, forest_trees=5, forest_depth=4,
                                        encoded=(rep.encoded, rep.feature_names)).collect()
    assert [r["model"] for r in board][0] is not None and len(board) == 4
    # lead time separates the classes in this file: the forest must see it
    assert max(r["accuracy"] for r in board) > 0.9
    scaled = bk.cancellation_leaderboard(b, forest_trees=5, forest_depth=4, cols=bk.CSV_COLUMNS,
                                         scale_features=True).collect()
    assert max(r["accuracy"] for r in scaled) > 0.9


def test_claims_csv_report(spark):
    from bizlens.plans.claims import claims_report
    from bizlens.sources import read_claims_csv
    d = tempfile.mkdtemp(prefix="bizlens-claims-")
    path = os.path.join(d, "claims.csv")
    with open(path, "w", encoding="latin-1") as fh:
        fh.write("claim_id,time_to_close,claim_amount,location,amount_paid,individuals_on_claim,linked_cases,cause\n")
        for i in range(1, 41):
            paid = "" if i % 10 == 0 else f"{1000 + i * 7.5:.2f}"
            linked = "" if i % 13 == 0 else ("True" if i % 2 else "False")
            cause = [" Meat", "VEGETABLES", "meat", "unknown", "vegetable"][i % 5]
            fh.write(f"{i},{100 + i * 9},R$ {2000 + i * 11.25:.2f},{['RECIFE', 'NATAL'][i % 2]},{paid},"
                     f"{1 + i % 15},{linked},{cause}\n")
    rep = claims_report(read_claims_csv(spark, path), ["RECIFE", "NATAL", "FORTALEZA", "SAO LUIS"])
    rules = {r["rule"]: r["failed"] for r in rep.rules.collect()}
    assert rules["amount_paid present"] == 4 and rules["linked_cases present"] == 3
    assert rep.cleaned.where("amount_paid is null or linked_cases is null").count() == 0
    assert sorted(r["cause"] for r in rep.causes.collect()) == ["meat", "unknown", "vegetable"]
    assert rep.boxes_after_cut.agg({"whisker_hi": "max"}).first()[0] < 350


def test_configure_for_scale(spark):
    from bizlens.session import configure_for_scale
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = configure_for_scale(spark, 100 * 10 ** 12, 8000)
        assert got["spark.sql.shuffle.partitions"] == "100000"
        got = configure_for_scale(spark, 10 ** 9, 8)
        assert got["spark.sql.shuffle.partitions"] == "16"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_runner_writes_reports(spark):
    from bizlens.__main__ import main
    from conftest import SF_SMALL
    out = tempfile.mkdtemp(prefix="bizlens-run-")
    assert main(["--input", SF_SMALL, "--output", out, "--queries", "cohort_retention,busiest_hours"]) == 0
    assert spark.read.parquet(os.path.join(out, "busiest_hours")).count() >= 2
    assert spark.read.parquet(os.path.join(out, "cohort_retention")).count() > 0
