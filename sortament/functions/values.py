"""Values as people type and read them: amounts, lists of changes, nested values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sortament.functions.text import grade_match_key, profile_key, squeeze_space


def number_text(value: Column) -> Column:
    """A number without zeros at its end, whole ones without a point; null stays null."""
    plain = value.cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def typed_number(text: Column) -> Column:
    """decimal(38,10) of a number with a comma or point; else null."""
    return F.translate(F.trim(text), ",", ".").try_cast("decimal(38,10)")


def availability_text(value: Column, unit: Column | None = None) -> Column:
    """An amount as shown: spaces squeezed; a number alone gets the column's ``unit``, if
    there is one, and a decimal point. Null and blank are ''."""
    text = squeeze_space(value)
    if unit is None:
        return text
    alone = text.rlike(r"^-?\d+(?:[.,]\d+)?$") & (F.coalesce(unit, F.lit("")) != "")
    return F.when(alone, F.concat_ws(" ", F.translate(text, ",", "."), unit)).otherwise(text)


def size_display(shown: Column, value: Column) -> Column:
    """A size as the source writes it where that says more than a number, else the number."""
    return F.coalesce(F.when(shown.rlike(r"[-(+]"), shown), number_text(value))


def flat_values(json: Column) -> Column:
    """array<string>: every text and number of a JSON value, however nested, in order, with
    spaces squeezed; names of fields, nulls, blanks and invalid JSON give none."""
    strings = r'"((?:[^"\\]|\\.)*)"\s*(:)?|(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false)'
    parts = [F.regexp_extract_all(json, F.lit(strings), F.lit(g)) for g in (1, 2, 3, 4)]
    joined = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("text", "name", "number", "flag"), strict=True)])
    values = F.transform(F.filter(joined, lambda x: x["name"] == ""), lambda x: squeeze_space(_unescaped(F.concat(x["text"], x["number"], x["flag"]))))
    valid = F.try_parse_json(json).isNotNull()
    return F.when(valid, F.filter(values, lambda v: v != "")).otherwise(F.array().cast("array<string>"))


def _unescaped(text: Column) -> Column:
    whole = F.get_json_object(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "$.v")
    return F.when(F.contains(text, F.lit("\\")), whole).otherwise(text)


def merged(old: Column, new: Column) -> Column:
    """``old`` with the entries of ``new``, which win; a null map is an empty one."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def parse_changes(assignments: Iterable[str]) -> dict[str, str | None]:
    """Changes typed as ``field=value``; null and none, in any case, are None. Raises
    ValueError for one without a field or sign, and for a field with two values."""
    changes: dict[str, str | None] = {}
    for typed in assignments:
        field, sign, value = (part.strip() for part in typed.partition("="))
        if not sign or not field:
            raise ValueError(f"a change is written as field=value: {typed!r}")
        known = None if value.lower() in ("null", "none") else value
        if changes.setdefault(field, known) != known:
            raise ValueError(f"two values for {field!r}")
    return changes


def _required(key: Column, what: str) -> Column:
    return F.when(F.coalesce(key, F.lit("")) == "", F.raise_error(F.lit(f"a {what} is required"))).otherwise(key)


def required_profile(value: Column) -> Column:
    """``profile_key``; a blank one fails the job."""
    return _required(profile_key(value), "profile")


def required_grade(value: Column) -> Column:
    """``grade_match_key``; a blank one fails the job."""
    return _required(grade_match_key(value), "grade")


def written_pattern(name: Column) -> Column:
    """A pattern (for rlike) that finds a name in a text, whatever spaces, points and
    hyphens stand between its letters and digits; not inside a word."""
    parts = F.filter(F.split(name, "[^0-9A-Za-zА-Яа-яЁё]+"), lambda p: p != "")
    letters = "0-9A-Za-zА-Яа-яЁё"
    return F.concat(F.lit(f"(?iu)(?<![{letters}])(?:"), F.array_join(parts, r"[\s_./\-–—]*"), F.lit(f")(?![{letters}])"))
