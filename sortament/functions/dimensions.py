"""Sizes, amounts and scores, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(18,6)"


def parse_price(text: Column) -> Column:
    """The first signed number of a price as written, decimal(18,4); else null."""
    plain = F.translate(F.regexp_replace(F.lower(text), r"(?U)руб\.?|₽|['’\s]", ""), ",", ".")
    return F.when(F.regexp_extract(plain, r"[-+]?\d+(?:\.\d+)?", 0) != "", F.regexp_extract(plain, r"[-+]?\d+(?:\.\d+)?", 0)).try_cast("decimal(18,4)")


def inch_fraction(text: Column) -> Column:
    """struct<text, inches decimal(18,6), mm decimal(18,6)> of a fraction of an inch with
    a denominator of 2, 4, 8, 16 or 32; null if there is none."""
    found = F.regexp_extract(text, r"(?<![0-9/.,])(\d+/(?:2|4|8|16|32))(?![0-9/])", 1)
    top, bottom = F.split(found, "/")[0].try_cast("decimal(9,0)"), F.split(found, "/")[1].try_cast("decimal(9,0)")
    inches = (top / bottom).cast(EXACT)
    return F.when(found != "", F.struct(found.alias("text"), inches.alias("inches"), (inches * F.lit("25.4").cast("decimal(4,1)")).cast(EXACT).alias("mm")))


def size_list(text: Column) -> Column:
    """array<decimal(18,6)> of up to three sizes joined by x, х, × or *; a part that is
    blank or not above 0 is null."""
    plain = F.regexp_replace(F.translate(F.lower(text), ",", "."), r'(?U)мм|mm|дюйм|in|["\s]', "")

    def value(part: Column) -> Column:
        split = F.split(part, "/")
        whole = F.when(F.size(split) == 2, (F.get(split, F.lit(0)).try_cast(EXACT) / F.get(split, F.lit(1)).try_cast(EXACT)).cast(EXACT)).otherwise(part.try_cast(EXACT))
        return F.when(whole > 0, whole)

    return F.transform(F.slice(F.split(plain, "[xх×*]"), 1, 3), value)


def sizes_match(wanted: list[Column], have: list[Column]) -> Column:
    """A null wanted size matches anything; a null size of the item matches nothing."""
    return reduce(Column.__and__, [w.isNull() | F.coalesce(w == h, F.lit(False)) for w, h in zip(wanted, have, strict=True)])


def size_similarity(wanted: list[Column], have: list[Column]) -> Column:
    """Mean over the wanted sizes of 1 less the relative deviation, at least 0; 0 if the
    item lacks one; null if none is wanted."""
    zero = F.lit(0.0)
    parts, lacking, count = zero, F.lit(False), F.lit(0)
    for w, h in zip(wanted, have, strict=True):
        off = F.abs(w - h).cast("double") / F.greatest(F.abs(w).cast("double"), F.lit(1e-6))
        parts = parts + F.when(w.isNotNull() & h.isNotNull(), F.greatest(zero, 1 - off)).otherwise(zero)
        lacking = lacking | (w.isNotNull() & h.isNull())
        count = count + w.isNotNull().cast("int")
    return F.when(count == 0, F.lit(None).cast("double")).when(lacking, zero).otherwise(parts / F.greatest(count, F.lit(1)))


def combined_score(grade: Column, sizes: Column) -> Column:
    """Three quarters grade and a quarter sizes; the grade alone where no size is wanted."""
    return F.when(sizes.isNull(), grade).otherwise(grade * 0.75 + sizes * 0.25)


def units_agree(a: Column, b: Column) -> Column:
    """Units given on both sides must be equal."""
    return a.isNull() | b.isNull() | (a == b)


def parser_confidence(*, grade_unknown: Column, sizes_unknown: Column, conflict: Column, unverified: Column, pending: Column, warnings: Column) -> Column:
    """1 less a part for each kind of doubt, at least 0."""
    doubts = F.lit(0.0)
    for flag, part in ((grade_unknown, 0.25), (sizes_unknown, 0.25), (conflict, 0.35), (unverified, 0.2), (pending, 0.15)):
        doubts = doubts + F.when(flag, part).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), 1 - doubts - F.least(F.lit(0.2), warnings * 0.05)), 6)
