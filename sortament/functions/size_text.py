"""Sizes as descriptions write them: sequences, ranges, alternatives and additions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"\d+(?:[.,]\d+)?"
#: A size: a number or range, with an alternative in brackets or an addition.
_SIZE = rf"{_NUMBER}(?:-{_NUMBER})?(?:\({_NUMBER}\))?(?:\+{_NUMBER})?"
_LETTER = "0-9A-Za-zА-Яа-яЁё"
#: After a sequence comes a unit, or no letter or further digit; but there may be a word for a length, as in 4х0,8хБУХТА.
_AFTER = rf"(?=\s*(?:мм|см|м|mm|cm|m)(?![{_LETTER}])|(?![.,]?[0-9]|[A-WYZa-wyzА-ФЦ-Яа-фц-яЁё]|\s*[xхXХ×*]\s*[0-9]))"
SEQUENCE = rf"(?<![{_LETTER}.,/-]){_SIZE}(?:\s*[xхXХ×*]\s*{_SIZE}){{1,3}}{_AFTER}"


def size_sequences(text: Column) -> Column:
    """array<string>: the sequences of two to four sizes in a text, as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SEQUENCE), F.lit(0))


def sequence_parts(sequence: Column) -> Column:
    """array<struct<value decimal(18,6), shown string>> of a sequence: the first number of
    each size, and the size as written where that says more (a range, an alternative or
    an addition)."""
    pieces = F.split(F.regexp_replace(sequence, r"\s+", ""), "[xхXХ×*]")
    return F.transform(
        pieces,
        lambda p: F.struct(F.translate(F.regexp_extract(p, _NUMBER, 0), ",", ".").try_cast("decimal(18,6)").alias("value"), F.when(p.rlike(r"[-(+]"), p).alias("shown")),
    )


def several_sets(text: Column) -> Column:
    """Whether a text holds two sequences joined by a plus or a spaced hyphen."""
    bare = rf"{_NUMBER}(?:\s*[xхXХ×*]\s*{_NUMBER}){{1,3}}"
    return F.coalesce(text.rlike(rf"{bare}\s*(?:\+|\s[-–—]\s)\s*{bare}"), F.lit(False))


def wall_of_tube(outer: Column, inner: Column) -> Column:
    """Half of outer less inner diameter; null unless that is above 0."""
    wall = ((outer - inner) / 2).cast("decimal(18,6)")
    return F.when(wall > 0, wall)


def looks_like_size(text: Column) -> Column:
    """Whether a cell begins with a number, after a sign of a diameter or "from" at most."""
    return F.lower(F.trim(text)).rlike(rf"^(?:[фø⌀]\s*)?(?:от\s+)?{_NUMBER}")


def looks_like_size_expression(text: Column) -> Column:
    """Whether a cell states sizes: a number, a range, numbers joined by x, or millimetres;
    a text that cites a standard doesn't."""
    low = F.lower(F.trim(text))
    several = low.rlike(r"\d\s*[xх×]\s*\d")
    alone = low.rlike(rf"^{_NUMBER}(?:\s*[-–—]\s*{_NUMBER})?$")
    return ~low.rlike("гост|ту |ост ") & low.rlike(r"\d") & (F.contains(low, F.lit("мм")) | several | alone)
