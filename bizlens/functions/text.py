"""String cleaning (ST1-ST4, CO5, D6, D16)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_pattern(c, pattern: str, literal: bool = True) -> Column:
    """Remove every match of ``pattern``; ``literal=True`` escapes it first."""
    pat = re.escape(pattern) if literal else pattern
    return F.regexp_replace(_col(c), pat, "")


def parse_number(c, to_type: str = "decimal(18,2)", lenient: bool = False) -> Column:
    """CO5: text -> number. Strict mode raises on bad input (ANSI cast)."""
    x = F.trim(_col(c))
    return x.try_cast(to_type) if lenient else x.cast(to_type)


def normalise_spelling(c, replacements: list[tuple[str, str]], lower: bool = True) -> Column:
    """ST2+ST3: optional lower-casing, then plain substring replacements in order."""
    x = _col(c)
    if lower:
        x = F.lower(x)
    for old, new in replacements:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def contains_text(c, needles: list[str], case_sensitive: bool = False, normalize: bool = False) -> Column:
    """FI6/ST4: true when ``c`` contains any of ``needles``.

    Case-insensitive matching is what the question text asks for ("banh mi" vs
    "Banh Mi", decision D6). ``normalize=True`` compares under Spark's Unicode
    collation, for which a decomposed accent equals a composed one; without it
    code points are compared.
    """
    x = _col(c)
    if normalize:
        x = F.collate(x, "UNICODE" if case_sensitive else "UNICODE_CI")
    elif not case_sensitive:
        x, needles = F.lower(x), [n.lower() for n in needles]
    cond = None
    for n in needles:
        t = F.contains(x, F.lit(n))
        cond = t if cond is None else (cond | t)
    return cond
