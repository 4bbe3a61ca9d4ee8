"""Quantities in different units to common units.

Conversions are edges of a graph, each an affine function y = a*x + b with exact
fractions. For every unit the shortest composition to a canonical unit is computed once
on the driver (the graph has tens of nodes and doesn't grow with the data), every cycle
is checked for consistency, and the rows get their factor by an equi-join on the source
unit and the canonical target.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortament.functions.numbers import AMOUNT, to_decimal

# Conversions (from, to, factor, offset).
CONVERSIONS = (
    ("t", "kg", "1000", "0"),
    ("centner", "kg", "100", "0"),
    ("kg", "g", "1000", "0"),
    ("lb", "g", "453.59237", "0"),
    ("t", "centner", "10", "0"),
    ("km", "m", "1000", "0"),
    ("m", "cm", "100", "0"),
    ("cm", "mm", "10", "0"),
    ("m", "mm", "1000", "0"),
    ("in", "mm", "25.4", "0"),
    ("ft", "in", "12", "0"),
    ("ft", "mm", "304.8", "0"),
    ("mm", "um", "1000", "0"),
    ("kpcs", "pcs", "1000", "0"),
)

# How units are written, in lower case without points and spaces.
SPELLINGS = {
    "t": ("т", "тн", "тонн", "тонна", "тонны", "t"),
    "centner": ("ц", "центнеров", "центнер", "центнера"),
    "kg": ("кг", "kg", "килограмм", "килограммов", "килограмма"),
    "g": ("г", "гр", "грамм", "граммов", "g"),
    "lb": ("lb", "lbs", "фунт", "фунтов", "фунта"),
    "km": ("км", "km"),
    "m": ("м", "m", "метр", "метров", "метра", "пм", "погм", "погметров"),
    "cm": ("см", "cm"),
    "mm": ("мм", "mm"),
    "ft": ("ft", "фут", "футов", "фута"),
    "in": ("in", "inch", "дюйм", "дюймов", "дюйма"),
    "kpcs": ("тысшт", "тысштук"),
    "pcs": ("шт", "штук", "штука", "штуки", "pcs"),
}


@dataclass(frozen=True)
class Affine:
    """y = scale * x + shift, exactly."""

    scale: Fraction
    shift: Fraction = Fraction(0)

    def then(self, other: Affine) -> Affine:
        return Affine(self.scale * other.scale, self.shift * other.scale + other.shift)

    def inverse(self) -> Affine:
        return Affine(1 / self.scale, -self.shift / self.scale)


class InconsistentUnits(ValueError):
    """Two ways between two units give different values."""


@dataclass
class UnitGraph:
    """Units and conversions between them."""

    edges: dict[str, dict[str, Affine]] = field(default_factory=dict)

    @classmethod
    def of(cls, conversions=CONVERSIONS) -> UnitGraph:
        graph = cls()
        for source, target, scale, shift in conversions:
            graph.add(source, target, Affine(Fraction(scale), Fraction(shift)))
        return graph

    def add(self, source: str, target: str, f: Affine) -> None:
        if f.scale == 0:
            raise InconsistentUnits(f"{source} to {target}: a factor of 0 has no inverse")
        known = self.edges.setdefault(source, {}).get(target)
        if known is not None and known != f:
            raise InconsistentUnits(f"{source} to {target} is given twice, differently")
        self.edges[source][target] = f
        self.edges.setdefault(target, {})[source] = f.inverse()

    def to(self, target: str) -> dict[str, Affine]:
        """The shortest composition from each reachable unit to ``target``; raises
        InconsistentUnits if any other way gives another function."""
        found = {target: Affine(Fraction(1))}
        queue = deque([target])
        while queue:
            unit = queue.popleft()
            for near in sorted(self.edges.get(unit, {})):
                if near not in found:
                    found[near] = self.edges[near][unit].then(found[unit])
                    queue.append(near)
        for unit, f in found.items():
            for near, edge in self.edges.get(unit, {}).items():
                if edge.then(found[near]) != f:
                    raise InconsistentUnits(f"the ways from {unit} to {target} disagree at {near}")
        return found


def conversion_table(
    spark: SparkSession, targets: tuple[str, ...], graph: UnitGraph | None = None, spellings=SPELLINGS
) -> DataFrame:
    """(spelling, base_unit, scale, shift, part): one row per spelling and target it converts
    to; the value is (scale x amount + shift) / part. ``part`` is 1 unless the factor has no
    finite decimal form, so nothing is rounded before the end."""
    graph = graph or UnitGraph.of()
    rows = []
    for target in targets:
        for unit, f in graph.to(target).items():
            for spelling in spellings.get(unit, ()):
                part = lcm(_endless(f.scale), _endless(f.shift))
                rows.append((spelling, target, _decimal(f.scale * part), _decimal(f.shift * part), part))
    return spark.createDataFrame(rows, "spelling string, base_unit string, scale string, shift string, part long").select(
        "spelling", "base_unit", F.col("scale").cast("decimal(19,9)").alias("scale"), F.col("shift").cast("decimal(19,9)").alias("shift"), "part"
    )


def _endless(x: Fraction) -> int:
    """The part of a denominator that gives no finite decimal."""
    rest = x.denominator
    for prime in (2, 5):
        while rest % prime == 0:
            rest //= prime
    return rest


def _decimal(x: Fraction) -> str:
    shown = format(Decimal(x.numerator) / Decimal(x.denominator), "f")
    if Fraction(shown) != x or abs(x) >= 10**10 or (x * 10**9).denominator != 1:
        raise ValueError(f"{x} has more digits than a factor may have")
    return shown


def _rounded(exact: Column, part: Column) -> Column:
    """``exact`` / ``part`` rounded half up, away from 0, without rounding in between."""
    size = F.abs(exact)
    whole = F.floor(size / part).cast("decimal(38,0)")
    whole = F.when(whole * part > size, whole - 1).otherwise(whole)  # a quotient may be rounded up to a whole
    up = F.when((size - whole * part) * 2 >= part, 1).otherwise(0)
    return (F.when(exact < 0, -1).otherwise(1) * (whole + up)).cast("long")


def unit_key(text: Column) -> Column:
    """A unit's spelling in lower case without points and spaces."""
    return F.regexp_replace(F.lower(text), r"(?U)[.\s]+", "")


def _unit_pattern(spellings=SPELLINGS) -> str:
    words = sorted({w for ws in spellings.values() for w in ws}, key=lambda w: (-len(w), w))
    # Points and spaces may stand after an abbreviation's parts.
    split = {"тысшт": r"тыс\.?\s*шт", "тысштук": r"тыс\.?\s*штук", "пм": r"п\.?\s?м", "погм": r"пог\.?\s?м", "погметров": r"пог\.?\s?метров"}
    return "|".join(split.get(w, re.escape(w)) for w in words)


UNIT = _unit_pattern()
NUMBER_THEN_UNIT = rf"(?iuU)(?<![\p{{L}}\p{{N}}.,])({AMOUNT})\s*({UNIT})(?!\p{{L}})"
UNIT_THEN_NUMBER = rf"(?iuU)(?<!\p{{L}})({UNIT})\.?\s*[:)—–-]\s*({AMOUNT})(?![\p{{L}}\p{{N}}])"
BARE_NUMBER = rf"(?iuU)^\s*(?:≈|~|ок\.?)?\s*({AMOUNT})\s*$"


def stated_amount(text: Column, outer_unit: Column | None = None) -> Column:
    """struct<amount decimal(18,6), unit string> that a free text states: a number and
    its unit, in either order. Where the text is a number alone, ``outer_unit`` is its
    unit. Both are null where there is none."""

    def blank_to_null(c: Column) -> Column:
        return F.when(c != "", c)

    after = blank_to_null(F.regexp_extract(text, NUMBER_THEN_UNIT, 1))
    before = blank_to_null(F.regexp_extract(text, UNIT_THEN_NUMBER, 2))
    number, unit = (
        F.coalesce(after, before),
        F.when(after.isNotNull(), F.regexp_extract(text, NUMBER_THEN_UNIT, 2)).when(before.isNotNull(), F.regexp_extract(text, UNIT_THEN_NUMBER, 1)),
    )
    if outer_unit is not None:
        bare = blank_to_null(F.regexp_extract(text, BARE_NUMBER, 1))
        unit = F.when(number.isNotNull(), unit).when(bare.isNotNull(), outer_unit)
        number = F.coalesce(number, bare)
    return F.struct(to_decimal(number).alias("amount"), unit_key(unit).alias("unit"))


def to_base(measures: DataFrame, targets: dict[str, tuple[str, ...]]) -> DataFrame:
    """``measures`` (measure, amount, unit, ...) with ``base_unit`` and ``base_value``
    (long, rounded half up), by an equi-join on the measure and the spelling of the unit.

    ``targets``: the canonical units of each measure. Rows without amount or with an
    unknown unit drop out; ``unknown_units`` lists those. The joined table has one row
    per spelling and target: its size is that of SPELLINGS, whatever the data.
    """
    spark = measures.sparkSession
    tables = [conversion_table(spark, t).withColumn("of", F.lit(m)) for m, t in targets.items()]
    table = reduce(DataFrame.unionByName, tables)
    on = (F.col("measure") == F.col("of")) & (F.col("unit") == F.col("spelling"))
    joined = measures.where(F.col("amount").isNotNull()).join(F.broadcast(table), on)
    exact = F.col("amount") * F.col("scale") + F.col("shift")
    part = F.col("part").cast("decimal(19,0)")
    value = F.when(F.col("part") == 1, F.round(exact, 0).cast("long")).otherwise(_rounded(exact, part))
    return joined.withColumn("base_value", value).drop("of", "spelling", "scale", "shift", "part", "amount", "unit")


def unknown_units(measures: DataFrame, amount: str, unit: str) -> DataFrame:
    """(unit, rows): amounts whose unit no spelling covers."""
    known = [(w,) for ws in SPELLINGS.values() for w in ws]
    table = measures.sparkSession.createDataFrame(known, "spelling string").distinct()
    left = measures.where(F.col(amount).isNotNull() & F.col(unit).isNotNull())
    return left.join(F.broadcast(table), F.col(unit) == F.col("spelling"), "left_anti").groupBy(F.col(unit).alias("unit")).agg(F.count(F.lit(1)).alias("rows"))


#: Canonical unit of each kind of stock, and of the first size.
STOCK_TARGETS = ("g", "mm", "pcs")
SIZE_TARGETS = ("um",)


def common_units(offers: DataFrame, raw_items: DataFrame) -> DataFrame:
    """(src, row_id, measure, base_unit, base_value) of stock and first size.

    In offers the two columns decide if both are given (a unit of blanks is not given),
    else the text of ``availability``; in raw items that text, whose unit may stand in
    ``extra_json.availability_unit``. Null, empty or unitless amounts and unknown units
    give no row; repeated rows give one row each key, measure and value. Other columns
    are not read. One scan of each table.
    """
    column_unit = unit_key(F.col("quantity_unit"))
    given = F.col("quantity_value").isNotNull() & (F.coalesce(column_unit, F.lit("")) != "")
    by_column = F.struct(F.col("quantity_value").cast("decimal(18,6)").alias("amount"), column_unit.alias("unit"))
    stock = F.when(given, by_column).otherwise(stated_amount(F.col("availability")))
    size = F.struct(F.col("dim1").cast("decimal(18,6)").alias("amount"), unit_key(F.col("dim1_unit")).alias("unit"))

    def measure(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("measure"), value["amount"].alias("amount"), value["unit"].alias("unit"))

    of_offers = offers.select(
        F.lit("offers").alias("src"), F.col("offer_id").alias("row_id"), F.inline(F.array(measure("quantity", stock), measure("dim1", size)))
    )
    outer = F.get_json_object("extra_json", "$.availability_unit")
    of_items = raw_items.select(
        F.lit("raw_items").alias("src"),
        F.col("item_id").alias("row_id"),
        F.inline(F.array(measure("quantity", stated_amount(F.col("availability"), outer)))),
    )
    both = of_offers.unionByName(of_items)
    return to_base(both, {"quantity": STOCK_TARGETS, "dim1": SIZE_TARGETS}).select("src", "row_id", "measure", "base_unit", "base_value")
