"""Ordered value bands (CO1, D11).

A band layout is a list of ``(label, upper_edge)`` or
``(label, upper_edge, closed)`` entries in increasing order plus a label for
everything above the last edge. ``closed='left'`` means the edge value belongs
to the *next* band (an ``x < edge`` test), ``closed='right'`` means it belongs to
the band it closes (``x <= edge``). Tests run in order and the first match
wins, like a searched CASE. A NULL input falls through to the top band, as a
CASE whose tests are all unknown does (both source layouts behave so).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two band layouts of the order-value questions.
# Order value: "< 50000" first, then inclusive BETWEEN ranges, so 50000 falls in
# the second band and 100000 in the second as well (first match wins).
ORDER_VALUE_BANDS = [
    ("0-50K", 50000, "left"), ("50K-100K", 100000), ("100K-200K", 200000),
    ("200K-400K", 400000), ("400K-600K", 600000),
]
ORDER_VALUE_TOP = ">600K"
GMV_BANDS = [
    ("1. 0-50k", 50000), ("2. 50-100k", 100000), ("3. 100-200k", 200000),
    ("4. 200-400k", 400000), ("5. 400-600k", 600000),
]
GMV_TOP = "6. Above 600k"


def band(c, edges, top_label: str, closed: str = "right", null_label: str | None = None) -> Column:
    """Label of the band ``c`` falls in; first matching band wins."""
    x = F.col(c) if isinstance(c, str) else c
    if closed not in ("left", "right"):
        raise ValueError("closed must be 'left' or 'right'")
    expr = None
    for entry in edges:
        label, edge = entry[0], entry[1]
        side = entry[2] if len(entry) > 2 else closed
        test = (x < F.lit(edge)) if side == "left" else (x <= F.lit(edge))
        expr = F.when(test, F.lit(label)) if expr is None else expr.when(test, F.lit(label))
    if null_label is not None:
        expr = expr.when(x.isNull(), F.lit(null_label))
    return expr.otherwise(F.lit(top_label))


def band_labels(edges, top_label: str) -> list[str]:
    return [e[0] for e in edges] + [top_label]


def band_ordinal(c, edges, top_label: str) -> Column:
    """Integer position (1-based) of a band label, for sorting."""
    labels = band_labels(edges, top_label)
    x = F.col(c) if isinstance(c, str) else c
    expr = None
    for i, label in enumerate(labels, start=1):
        expr = F.when(x == label, F.lit(i)) if expr is None else expr.when(x == label, F.lit(i))
    return expr
