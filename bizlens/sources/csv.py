"""SC2: CSV with header and an explicit schema.

Files exported from spreadsheets often are Latin-1; that decoding is the
default here. Backslash sequences are kept as text (no unescaping, D15).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             encoding: str = "ISO-8859-1", header: bool = True, **options) -> DataFrame:
    reader = (spark.read.schema(schema)
              .option("header", header)
              .option("encoding", encoding)
              .option("mode", options.pop("mode", "FAILFAST")))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


# Column layout of the two CSV inputs of the source analyses.
CLAIMS_CSV_SCHEMA = ("claim_id long, time_to_close int, claim_amount string, location string, "
                     "amount_paid double, individuals_on_claim int, linked_cases boolean, cause string")
BOOKINGS_CSV_SCHEMA = ("Booking_ID string, no_of_adults int, no_of_children int, no_of_weekend_nights int, "
                       "no_of_week_nights int, type_of_meal_plan string, required_car_parking_space int, "
                       "room_type_reserved string, lead_time int, arrival_year int, arrival_month int, "
                       "arrival_date int, market_segment_type string, repeated_guest int, "
                       "no_of_previous_cancellations int, no_of_previous_bookings_not_canceled int, "
                       "avg_price_per_room double, no_of_special_requests int, booking_status string")


def read_claims_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """The claims file (8 columns); ``claim_amount`` stays text until cleaned."""
    return read_csv(spark, path, CLAIMS_CSV_SCHEMA, **options)


def read_bookings_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """The hotel bookings file (19 columns)."""
    return read_csv(spark, path, BOOKINGS_CSV_SCHEMA, **options)
