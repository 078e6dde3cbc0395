"""Readers, samplers, sinks and the order-mart adapter (SC1-SC7)."""

from bizlens.sources.tables import TABLES, load_table, load_tables
from bizlens.sources.csv import read_bookings_csv, read_claims_csv, read_csv
from bizlens.sources.samples import sample_rows, sample_by, head_rows, tail_rows
from bizlens.sources.sinks import write_report
from bizlens.sources.mart import OrderMart, claims_frame, events_as_orders, lines_mart, order_facts, orders_mart

__all__ = [
    "TABLES", "load_table", "load_tables", "read_csv", "read_claims_csv", "read_bookings_csv", "sample_rows", "sample_by", "head_rows",
    "tail_rows", "write_report", "OrderMart", "orders_mart", "lines_mart", "events_as_orders",
    "claims_frame", "order_facts",
]
