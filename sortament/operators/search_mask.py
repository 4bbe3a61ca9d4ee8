"""Free-text search in which every field may be left out.

The short query is read on the driver; it needs the inventory's distinct profiles and
grades, which are aggregated and bounded. Everything else is one filter and a sort.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortament.functions.profiles import PROFILE_STEMS, ROUND_BARS
from sortament.functions.text import CYRILLIC_TWINS, LATIN_TWINS, compact_key

# Words that don't narrow a search.
STOPWORDS = ("И", "ИЛИ", "ИЗ", "В", "ВО", "НА", "ПО", "ДЛЯ", "С", "СО", "ПОД", "ПРИ", "ММ", "СМ", "М")
# Fixed value: a term of a text in upper case.
TERM = r"[0-9A-ZА-ЯЁ]+(?:[-_/][0-9A-ZА-ЯЁ]+)*"
EXACT, NEAREST = "ТОЧНОЕ", "БЛИЖАЙШИЙ РАЗМЕР"
_WORD = re.compile(TERM)
_NUM = r"\d+(?:[.,]\d+)?"
_SIZES = re.compile(rf"(?<![\w.,-])({_NUM}(?:\s*[xх×*]\s*{_NUM}){{1,2}})(?![\w-])", re.I)
_MARKED = re.compile(rf"(?<!\w)(?:ø|ф|д|№|#|n)\s*({_NUM})(?!\w)|(?<![\w.,-])({_NUM})\s*(?:мм|см|м)(?!\w)", re.I)
_BARE = re.compile(rf"(?<![\w.,/-])({_NUM})(?![\w.,/-])(?!\s*(?:кг|шт|%|т(?!\w)))", re.I)
_STANDARD = re.compile(r"(?:гост|ост|ту|стп|din|astm|en|aisi)\s*$", re.I)


@dataclass(frozen=True)
class Mask:
    """What a query asks for; empty fields don't filter."""

    raw: str
    grade_key: str | None = None
    sizes: tuple[Decimal, ...] = ()
    profiles: tuple[str, ...] = ()
    asked_profile: str | None = None
    terms: tuple[str, ...] = ()

    @property
    def empty(self) -> bool:
        return not (self.grade_key or self.sizes or self.profiles or self.terms)


@dataclass(frozen=True)
class Inventory:
    """The distinct profiles and the spelling of each grade key of what is searched."""

    profiles: frozenset[str]
    grades: dict[str, str] = field(default_factory=dict)


def inventory_of(items: DataFrame, *, most: int = 100_000) -> Inventory:
    """The inventory's vocabulary; raises if it has more than ``most`` different grades,
    which a driver shouldn't hold."""
    profiles = [r[0] for r in items.where("profile is not null").select("profile").distinct().limit(most + 1).collect()]
    keys = items.where("grade is not null").groupBy(compact_key(F.col("grade")).alias("key")).agg(F.min("grade").alias("grade")).where("key <> ''").limit(most + 1).collect()
    if max(len(keys), len(profiles)) > most:
        raise ValueError(f"more than {most} different grades or profiles")
    return Inventory(frozenset(profiles), {r["key"]: r["grade"] for r in keys})


def _fold(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.upper().translate(str.maketrans(CYRILLIC_TWINS, LATIN_TWINS)))


def _decimal(text: str) -> Decimal:
    return Decimal(text.replace(",", "."))


def read_mask(query: str, inventory: Inventory) -> Mask:
    """The mask of a free text. The grade is looked for first (the longest that the
    inventory has), then sizes (AxB, marked or with a unit, else the rightmost bare
    number that is neither a standard's nor an amount), then the profile."""
    text = re.sub(r"\s+", " ", query or "").strip()
    grade_key, rest = None, text
    words = list(re.finditer(r"[^\s,;]+", text))
    longest = max(map(len, inventory.grades), default=0)
    for count in range(len(words), 0, -1):
        for i in range(len(words) - count + 1):
            key = _fold(text[words[i].start() : words[i + count - 1].end()])
            if len(key) > longest:
                continue
            if key in inventory.grades and not key.isdigit():
                grade_key, rest = key, text[: words[i].start()] + " " + text[words[i + count - 1].end() :]
                break
        if grade_key:
            break
    sizes: tuple[Decimal, ...] = ()
    if m := _SIZES.search(rest):
        sizes = tuple(_decimal(n) for n in re.split(r"\s*[xх×*]\s*", m[1], flags=re.I))
        rest = rest[: m.start()] + " " + rest[m.end() :]
    elif m := _MARKED.search(rest):
        sizes, rest = (_decimal(m[1] or m[2]),), rest[: m.start()] + " " + rest[m.end() :]
    else:
        for m in reversed(list(_BARE.finditer(rest))):
            if not _STANDARD.search(rest[: m.start()]):
                sizes, rest = (_decimal(m[1]),), rest[: m.start()] + " " + rest[m.end() :]
                break
    asked = None
    for name, stems in PROFILE_STEMS.items():
        if any(re.search(rf"(?<!\w){s}", rest.lower().replace("ё", "е")) for s in stems):
            asked = name
            break
    group = ROUND_BARS if asked in ROUND_BARS else (asked,) if asked else ()
    profiles = tuple(p for p in group if p in inventory.profiles)
    tokens = set(_WORD.findall(rest.upper()))
    named = PROFILE_STEMS.get(asked, ()) if profiles else ()
    terms = tuple(sorted(t for t in tokens if t not in STOPWORDS and not t.isdigit() and not any(t.lower().startswith(s) for s in named)))
    return Mask(text, grade_key, sizes, profiles, asked if profiles else None, terms)


def _has_term(tokens: Column, term: str) -> Column:
    """A token equals the term or, from four letters on, one begins with the other."""
    if len(term) < 4:
        return F.array_contains(tokens, term)
    return F.exists(tokens, lambda t: (t == term) | t.startswith(term) | ((F.length(t) >= 4) & F.startswith(F.lit(term), t)))


def mask_search(items: DataFrame, mask: Mask, *, sizes: tuple[str, ...] = ("dim1", "dim2", "dim3"), text: str = "raw_description") -> DataFrame:
    """``items`` that the mask finds, with ``match_type``, ``deltas`` (absolute deviation
    of each asked size), ``size_delta`` (their sum) and ``rank`` columns in place for
    ``ranked``. Items that lack an asked size don't match; there is no greatest deviation.
    An empty mask finds nothing."""
    if mask.empty:
        return mask_columns(items.where(F.lit(False)), mask, sizes)
    where = F.lit(True)
    if mask.profiles:
        where = where & F.col("profile").isin(*mask.profiles)
    if mask.grade_key:
        where = where & (compact_key(F.col("grade")) == mask.grade_key)
    for column, _ in zip(sizes, mask.sizes, strict=False):
        where = where & F.col(column).isNotNull()
    if mask.terms:
        words = F.regexp_extract_all(F.upper(F.concat_ws(" ", "profile", text, "comment_text")), F.lit(TERM), F.lit(0))
        for term in mask.terms:
            where = where & _has_term(words, term)
    return mask_columns(items.where(where), mask, sizes)


def mask_columns(items: DataFrame, mask: Mask, sizes: tuple[str, ...]) -> DataFrame:
    deltas = [F.abs(F.col(c) - F.lit(str(v)).cast("decimal(18,6)")).cast("double") for c, v in zip(sizes, mask.sizes, strict=False)]
    total = sum(deltas[1:], deltas[0]) if deltas else F.lit(0.0)
    largest = F.greatest(*deltas, F.lit(0.0)) if deltas else F.lit(0.0)
    penalty = F.when(F.lit(mask.asked_profile is not None) & (F.col("profile") != F.lit(mask.asked_profile)), 1).otherwise(0)
    found = items.withColumn("size_delta", F.round(total, 6)).withColumn("largest_delta", F.round(largest, 6)).withColumn("profile_penalty", penalty)
    return found.withColumn("match_type", F.when(F.col("size_delta") == 0, EXACT).otherwise(NEAREST))


def ranked(found: DataFrame, *tie_breaks: str) -> DataFrame:
    """Exact hits first, then by deviation, the asked profile before its group's others."""
    return found.orderBy(F.col("match_type") != EXACT, "size_delta", "largest_delta", "profile_penalty", *tie_breaks)


def expand_round_bars(found: DataFrame) -> DataFrame:
    """Each hit of a round bar once under each of its two names, ``is_profile_alias`` for
    the one it doesn't have; other hits as they are. No shuffle."""
    other = F.when(F.col("profile") == ROUND_BARS[0], ROUND_BARS[1]).when(F.col("profile") == ROUND_BARS[1], ROUND_BARS[0])
    own = F.struct(F.col("profile").alias("display_profile"), F.lit(False).alias("is_profile_alias"))
    alias = F.struct(other.alias("display_profile"), F.lit(True).alias("is_profile_alias"))
    return found.select("*", F.inline(F.when(other.isNotNull(), F.array(own, alias)).otherwise(F.array(own))))
