"""Claims report (RP13): clean, validate, profile, and compare distributions
before and after an outlier cut. Each step is a lazy frame; the caller
persists the cleaned frame when several outputs are computed from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.operators import clean, distributions, profile
from bizlens.session import reliable
from bizlens.sources.samples import tail_rows


def clean_claims(claims: DataFrame) -> DataFrame:
    """Currency text -> decimal, mean-imputed payment, missing flag -> False,
    cause spellings collapsed to three categories."""
    df = clean.strip_currency(claims, "claim_amount")
    df = clean.fill_mean(df, "amount_paid", exact_scale=3)
    df = clean.fill_value(df, "linked_cases", False)
    return clean.normalise_category(df, "cause")


#: The ranges and causes of the data description.
CLAIM_RANGES = {"time_to_close": (0, 1000), "claim_amount": (1637.94, 76106.80), "amount_paid": (1516.72, 52497.75),
                "individuals_on_claim": (1, 15)}
CAUSES = ("vegetable", "meat", "unknown")


def claims_rules(claims: DataFrame, locations, ranges: dict | None = None, causes=CAUSES) -> DataFrame:
    """The data-description checks as rule rows (PR7).

    ``ranges`` replaces bounds by column; ``claim_amount`` is checked as the
    number in its currency text.
    """
    bounds = {**CLAIM_RANGES, **(ranges or {})}
    df = clean.strip_currency(claims, "claim_amount") if dict(claims.dtypes)["claim_amount"] == "string" else claims
    span = lambda name, column: {"name": f"{name} in range", "column": column, "kind": "range",
                                 "lo": bounds[column][0], "hi": bounds[column][1]}
    return profile.quality_rules(df, [
        {"name": "claim_id unique", "column": "claim_id", "kind": "unique"},
        span("time_to_close", "time_to_close"),
        span("claim_amount", "claim_amount"),
        span("amount_paid", "amount_paid"),
        {"name": "location allowed", "column": "location", "kind": "allowed", "values": list(locations)},
        {"name": "cause allowed", "column": "cause", "kind": "allowed", "values": list(causes)},
        {"name": "amount_paid present", "column": "amount_paid", "kind": "not_null"},
        {"name": "linked_cases present", "column": "linked_cases", "kind": "not_null"},
        span("individuals", "individuals_on_claim"),
    ])


def claims_by_location(claims: DataFrame) -> DataFrame:
    """DS7: claims per location, ascending by location (bar chart data)."""
    return (claims.groupBy("location").agg(F.count("claim_id").alias("total_claim"))
                  .orderBy("location"))


def time_to_close_histogram(claims: DataFrame, bins: int = 50) -> DataFrame:
    return distributions.histogram(claims, "time_to_close", bins)


def time_to_close_boxes(claims: DataFrame, cut_below: float | None = None) -> DataFrame:
    """Box statistics of time to close per location, optionally after the cut."""
    df = clean.cut_above(claims, "time_to_close", cut_below) if cut_below is not None else claims
    return distributions.box_stats(df, "time_to_close", "location")


@dataclass
class ClaimsReport:
    cleaned: DataFrame            # cleaned claims (checkpointed once, feeds every output)
    rules: DataFrame              # rule, column, checked, failed
    nulls: DataFrame              # NULL count per raw column
    causes: DataFrame             # cause, n (after normalisation)
    by_location: DataFrame        # location, total_claim
    histogram: DataFrame          # bin, bin_lo, bin_hi, n of time to close
    boxes: DataFrame              # box statistics per location, all claims
    boxes_after_cut: DataFrame    # the same after the outlier cut
    tail: DataFrame               # last rows by claim id after the cut


def claims_report(claims: DataFrame, locations, cut_below: float = 350, bins: int = 50,
                  tail_rows_n: int = 10) -> ClaimsReport:
    """RP13 in one call: the raw frame is profiled, cleaned once (checkpointed
    to the reliable folder) and every distribution is computed from that."""
    cleaned = reliable(clean_claims(claims), spread=True)
    after_cut = clean.cut_above(cleaned, "time_to_close", cut_below)
    return ClaimsReport(
        cleaned=cleaned,
        rules=claims_rules(claims, locations),
        nulls=profile.null_counts(claims),
        causes=cleaned.groupBy("cause").agg(F.count(F.lit(1)).alias("n")),
        by_location=claims_by_location(cleaned),
        histogram=time_to_close_histogram(cleaned, bins),
        boxes=time_to_close_boxes(cleaned),
        boxes_after_cut=time_to_close_boxes(cleaned, cut_below),
        tail=tail_rows(after_cut, tail_rows_n, "claim_id"))
