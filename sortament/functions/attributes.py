"""Attributes that some profiles have, and names and texts made of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_B, _E = "(?<![0-9A-ZА-ЯЁ_])", "(?![0-9A-ZА-ЯЁ_])"
# Parameters of mesh designations (wires a decimetre, warp and weft in mm).
MESHES = {"П32": (32, "0.60", "0.40"), "П48": (48, "0.45", "0.30")}


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    value = F.regexp_extract(text, pattern, group)
    return F.when(value != "", value)


def _upper(text: Column) -> Column:
    return F.translate(F.upper(F.coalesce(text, F.lit(""))), "Ё", "Е")


def scrap_attributes(text: Column) -> Column:
    """struct<scrap_group, material_grade, form> of a scrap's description."""
    up = _upper(text)
    group = _found(up, rf"{_B}(Б\d{{1,3}}){_E}|ГР(?:УППА)?\.?\s*(Б\d{{1,3}}){_E}", 0)
    grade = F.translate(_found(up, rf"{_B}(\d{{1,3}}[ХX][0-9А-ЯA-Z-]+){_E}"), "X", "Х")
    return F.struct(_found(group, r"(Б\d{1,3})").alias("scrap_group"), grade.alias("material_grade"), F.when(up.rlike(f"{_B}КУСОК{_E}"), "КУСОК").alias("form"))


def mesh_attributes(text: Column) -> Column:
    """struct<mesh, width_mm, warp_count, warp_mm, weft_mm> of a mesh's description."""
    up = _upper(text)
    code = _found(up, rf"{_B}(П\d{{1,3}}){_E}")
    known = F.create_map(*[x for k, (n, a, b) in MESHES.items() for x in (F.lit(k), F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")))])
    at = F.try_element_at(known, F.coalesce(code, F.lit("")))
    width = F.translate(_found(up, rf"{_B}Ш(?:ИР)?\.?\s*(\d+(?:[.,]\d+)?)"), ",", ".")
    return F.struct(code.alias("mesh"), F.when(code.isNotNull(), width).alias("width_mm"), at["n"].alias("warp_count"), at["a"].alias("warp_mm"), at["b"].alias("weft_mm"))


def display_name(profile: Column, grade: Column, size_text: Column) -> Column:
    """Profile with a capital, grade and size as shown, without gaps for what is missing."""
    return F.concat_ws(" ", F.initcap(F.lower(profile)), grade, size_text)


def structured_sizes(profile: Column, primary: Column, secondary: Column) -> Column:
    """array<decimal(18,6)> of up to three sizes from two columns: of bars and wire one
    from each, of tubes two and one, else all of both."""

    def parts(text: Column) -> Column:
        pieces = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), ",", "."), r"(?U)\s*[xхXХ×*]\s*"), lambda p: p.rlike(r"\d"))
        return F.transform(pieces, lambda p: F.regexp_extract(p, r"\d+(?:\.\d+)?", 0).try_cast("decimal(18,6)"))

    a, b = parts(primary), parts(secondary)
    bars = profile.isin("КРУГ", "ПРУТОК", "ПРОВОЛОКА", "ШЕСТИГРАННИК")
    chosen = F.when(bars, F.concat(F.slice(a, 1, 1), F.slice(b, 1, 1))).when(profile == "ТРУБА", F.concat(F.slice(a, 1, 2), F.slice(b, 1, 1))).otherwise(F.concat(a, b))
    return F.slice(chosen, 1, 3)


def safe_file_name(name: Column) -> Column:
    """Without path, control and reserved signs; never empty."""
    plain = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r'[<>:"|?*\x00-\x1f]+', "_")
    trimmed = F.regexp_replace(plain, r"^[ ._]+|[ ._]+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", "attachment").otherwise(trimmed)


def redact(text: Column) -> Column:
    """Without keys, bearer tokens and passwords in addresses."""
    plain = F.regexp_replace(text, r"(?i)\b(?:sk|key)-[A-Za-z0-9_-]{8,}", "[REDACTED]")
    plain = F.regexp_replace(plain, r"(?i)(bearer\s+)\S+", "$1[REDACTED]")
    return F.regexp_replace(plain, r"(://[^:/\s@]+:)[^@\s/]+@", "$1***@")


def append_comment(comments: Column, note: Column) -> Column:
    """The note after the comments unless they hold it."""
    old = F.coalesce(comments, F.lit(""))
    return F.when(F.coalesce(note, F.lit("")) == "", comments).when(old == "", note).when(F.contains(old, note), comments).otherwise(F.concat(old, F.lit("; "), note))
