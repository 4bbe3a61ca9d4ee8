"""Numbers inside free text, as column expressions and regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thousands may be grouped by ordinary or no-break spaces or an apostrophe.
GROUP_SIGNS = " \u00a0\u202f'\u2019"
AMOUNT = rf"(?:\d{{1,3}}(?:[{GROUP_SIGNS}]\d{{3}})+(?!\d)|\d+)(?:[.,]\d+)?"


def to_decimal(col: Column, kind: str = "decimal(18,6)") -> Column:
    """A number as written in a price list; null if it is none or doesn't fit."""
    plain = F.translate(F.regexp_replace(col, rf"[{GROUP_SIGNS}\s]", ""), ",", ".")
    return plain.try_cast(kind)
