"""The sizes that a description states, by the first rule of its profile that applies.

Rules are data: which profiles they hold for, and how sizes are found. All are built-in
expressions, so reading sizes is one projection without a shuffle or Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortament.functions.dimensions import EXACT, inch_fraction
from sortament.functions.profiles import PROFILE_STEMS
from sortament.functions.size_text import sequence_parts, several_sets, size_sequences, wall_of_tube
from sortament.functions.text import squeeze_space

_N, _BY = r"(\d+(?:\.\d+)?)", r"\s*[xXхХ×*]\s*"
_L = "0-9A-Za-zА-Яа-яЁё_"
_B, _E = f"(?<![{_L}])", f"(?![{_L}])"
# Signs of a diameter, of a section's number, and of a length.
DIAMETER = r"(?:[ØøФф]|[Дд]\s*[=:.-]?)\s*"
NUMBER = r"(?:№|N)\s*0*"
LENGTH = r"(?:длина|L)\s*[:=.-]?\s*"
# Profiles whose sizes are read in the same way.
BARS, WIRES = ("КРУГ", "ПРУТОК"), ("ПРОВОЛОКА", "ШЕСТИГРАННИК")
FLAT = ("ЛИСТ", "ПЛИТА", "ЛЕНТА", "ПОЛОСА", "КВАДРАТ", "ПОКОВКА", "АНОД", "ШИНА", "ПРОВОДНИК", "КОЛЬЦО")
#: Designations with an Х between digits that a letter follows: no sizes, however they look.
_CROSSED = r"(?<![\w.,])\d{1,3}[ХхXx]\d+(?:[А-ФЦ-Яа-фц-яЁё]\d*)+"


def _sizes(*values: Column) -> Column:
    """Three sizes, null unless the first is there."""
    three = [*values, *[F.lit(None)] * (3 - len(values))]
    return F.when(values[0].isNotNull(), F.struct(*[v.cast(EXACT).alias(f"dim{i}") for i, v in enumerate(three, 1)]))


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, f"(?iu){pattern}", group).try_cast(EXACT)


def _pattern(pattern: str, count: int) -> Callable[[Column], Column]:
    return lambda t: _sizes(*[_group(t, pattern, g) for g in range(1, count + 1)])


def _sequence(t: Column) -> Column:
    parts = sequence_parts(F.get(size_sequences(t), F.lit(0)))
    return _sizes(*[F.get(parts, F.lit(i))["value"] for i in range(3)])


def _tube_after_word(t: Column) -> Column:
    stem = "|".join(PROFILE_STEMS["ТРУБА"])
    return _pattern(rf"{_B}(?:{stem})[{_L}]*\s*[ØФ]?\s*{_N}{_BY}{_N}(?=\s|$|[(),;])", 2)(t)


def _tube_by_diameters(t: Column) -> Column:
    outer, inner = (_group(t, rf"{_B}{a}\.?D\.?\s*[:=]?\s*{_N}") for a in "OI")
    return _sizes(outer, F.when(inner.isNotNull(), wall_of_tube(outer, inner)), _group(t, rf"{LENGTH}{_N}"))


def _bar_second(t: Column) -> Column:
    """A bar's second size: a length, else what stands after the sign of a thickness."""
    return F.coalesce(_group(t, rf"{_B}{LENGTH}{_N}"), _group(t, rf"{_B}(?:т\.?|толщ(?:ина)?)\s*{_N}"))


def _bar_sequence(t: Column) -> Column:
    three = _sequence(t)
    return _sizes(three["dim1"], F.coalesce(three["dim2"], _bar_second(t)), three["dim3"])


_millimetres = rf"(?<![\d.]){_N}\s*мм{_E}"


@dataclass(frozen=True)
class SizeRule:
    """``profiles``: those it holds for, none for all. ``sizes``: struct<dim1, dim2, dim3>
    of a text, null where it doesn't apply. ``note``: what to say of its result."""

    name: str
    profiles: tuple[str, ...]
    sizes: Callable[[Column], Column]
    note: str | None = None


#: In the order in which they are tried.
RULES = (
    SizeRule("SEQUENCE", ("ПОЛОСА", "ЛЕНТА"), _sequence),
    SizeRule("CONDUCTOR", ("ПРОВОДНИК",), _pattern(rf"{_B}OD\s*{_N}{_BY}{_N}.*?{_B}ID\s*{_N}", 3), "OUTER_SECTION_AND_CHANNEL"),
    SizeRule("DISC", ("ЛИСТ", "ДИСК"), lambda t: F.when(t.rlike(rf"(?iu){_B}диск{_E}"), _pattern(rf"{_N}\s*\*?\s*(?:диам\.?|[dдØ])\s*{_N}", 2)(t)), "PROFILE_TO_BE_DECIDED"),
    SizeRule("FLANGE", ("ФЛАНЕЦ",), lambda t: F.when(t.rlike(rf"(?iu){_B}Ду\s*\d.*?{_B}Ру\s*\d"), _pattern(rf"{_B}Ду\s*{_N}", 1)(t)), "NOMINAL_SIZE"),
    SizeRule("MESH", ("СЕТКА",), _pattern(rf"{_B}(?:шир\.?|ш\.)\s*{_N}", 1), "WIDTH"),
    SizeRule("ACROSS_FLATS", ("ШЕСТИГРАННИК",), _pattern(rf"{_B}S\s*{_N}{_E}", 1), "SIZE_TO_BE_DECIDED"),
    SizeRule("RING", ("ПЛИТА", "КОЛЬЦО"), _pattern(rf"{_N}{_BY}[dд]\s*{_N}\s*/\s*[dд]\s*{_N}", 3), "PROFILE_TO_BE_DECIDED"),
    SizeRule("RANDOM_LENGTH", ("ПРУТОК",), _pattern(rf"(?<![\w.]){_N}{_BY}НД{_E}", 1), "RANDOM_LENGTH"),
    SizeRule("TUBE", ("ТРУБА",), _tube_after_word),
    SizeRule("TUBE_DIAMETER", ("ТРУБА",), _pattern(rf"{DIAMETER}{_N}{_BY}{_N}", 2)),
    SizeRule("TUBE_INCHES", ("ТРУБА",), lambda t: _sizes(inch_fraction(t)["inches"]), "INCHES"),
    SizeRule("THREAD", ("БОЛТ", "ВИНТ", "ШПИЛЬКА"), _pattern(rf"{_B}М\s*{_N}{_BY}{_N}", 2)),
    SizeRule("THREAD_ALONE", ("ГАЙКА", "ШАЙБА"), _pattern(rf"{_B}М\s*{_N}", 1)),
    SizeRule("TUBE_OUTER_INNER", ("ТРУБА",), _tube_by_diameters, "WALL_COMPUTED"),
    SizeRule("DIAMETER_PAIR", BARS, _pattern(rf"{DIAMETER}{_N}{_BY}{_N}", 2)),
    SizeRule("DIAMETER", BARS, lambda t: _sizes(_group(t, rf"{DIAMETER}{_N}"), _bar_second(t))),
    SizeRule("SECTION_NUMBER", BARS, lambda t: _sizes(_group(t, rf"{NUMBER}{_N}"), _bar_second(t))),
    SizeRule("SEQUENCE", BARS, _bar_sequence),
    SizeRule("MILLIMETRES", BARS, lambda t: _sizes(_group(t, _millimetres), _bar_second(t))),
    SizeRule("DIAMETER", WIRES, _pattern(rf"{DIAMETER}{_N}", 1)),
    SizeRule("SECTION_NUMBER", WIRES, _pattern(rf"{NUMBER}{_N}", 1)),
    SizeRule("SEQUENCE", (*WIRES, "ТРУБА", *FLAT), _sequence),
    SizeRule("MILLIMETRES", WIRES, _pattern(_millimetres, 1)),
    SizeRule("SECTION_NUMBER", ("КВАДРАТ",), _pattern(rf"{NUMBER}{_N}", 1)),
    SizeRule("SEQUENCE", (), _sequence, "ORDER_OF_SOURCE"),
    SizeRule("DIAMETER", (), _pattern(rf"{DIAMETER}{_N}", 1)),
    SizeRule("SECTION_NUMBER", (), _pattern(rf"{NUMBER}{_N}", 1)),
)


def sizes_in_text(rows: DataFrame, key: str, text: str, profile: str, grade: str | None = None, rules: tuple[SizeRule, ...] = RULES) -> DataFrame:
    """(key, dim1, dim2, dim3, display1, display2, display3, rule, notes) of each row.

    Sizes are as written, in the text's own units. Designations with an Х between digits,
    and the row's ``grade`` as written if that column is named, are no sizes. Of two sets
    in one text the first is read (rule SEVERAL_SETS). ``display``: a part of the first
    sequence that says more than a number (a range, an alternative, an addition). ``notes``
    say what of the result needs a look. Nulls, blank and very long texts are read like
    any other; without any size all are null and the rule is NONE.
    """
    plain = F.translate(squeeze_space(F.col(text)), ",", ".")
    if grade is not None:
        known = F.translate(squeeze_space(F.col(grade)), ",", ".")
        plain = F.when(known.rlike("[A-Za-zА-Яа-я]"), F.replace(plain, known, F.lit(" "))).otherwise(plain)
    read = rows.select(F.col(key).alias("_key"), F.upper(F.coalesce(F.col(profile), F.lit(""))).alias("_profile"), F.regexp_replace(plain, _CROSSED, " ").alias("_text"))
    t, p = F.col("_text"), F.col("_profile")
    parts = sequence_parts(F.get(size_sequences(t), F.lit(0)))
    found = [F.when(several_sets(t), F.struct(F.lit("SEVERAL_SETS").alias("rule"), F.lit("SEVERAL_SETS").alias("note"), _sequence(t).alias("sizes")))]
    for r in rules:
        sizes = r.sizes(t) if not r.profiles else F.when(p.isin(*r.profiles), r.sizes(t))
        found.append(F.when(sizes.isNotNull(), F.struct(F.lit(r.name).alias("rule"), F.lit(r.note).cast("string").alias("note"), sizes.alias("sizes"))))
    chosen = read.withColumn("_r", F.coalesce(*found)).withColumn("_parts", parts)
    bad_tube = (F.col("_r.rule") == "TUBE_OUTER_INNER") & F.col("_r.sizes.dim2").isNull() & t.rlike(rf"(?iu){_B}I\.?D\.?\s*[:=]?\s*\d")
    note = F.when(F.col("_r.note") == "WALL_COMPUTED", F.when(F.col("_r.sizes.dim2").isNotNull(), "WALL_COMPUTED").when(bad_tube, "INNER_NOT_BELOW_OUTER")).otherwise(F.col("_r.note"))
    notes = F.array_compact(F.array(note, F.when(F.size("_parts") > 3, "FOURTH_SIZE")))
    shown = [F.get("_parts", F.lit(i))["shown"].alias(f"display{i + 1}") for i in range(3)]
    return chosen.select(F.col("_key").alias(key), *[F.col(f"_r.sizes.dim{i}").alias(f"dim{i}") for i in (1, 2, 3)], *shown, F.coalesce("_r.rule", F.lit("NONE")).alias("rule"), notes.alias("notes"))
