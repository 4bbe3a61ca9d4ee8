"""Text normalisation as column expressions; everything here stays in the JVM.

Nulls stay null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that look alike in both alphabets, upper case.
CYRILLIC_TWINS = "АВЕКМНОРСТУХЁ"
LATIN_TWINS = "ABEKMHOPCTYXE"

# Fixed value: words that may stand before a designation.
MATERIAL_WORDS = ("сталь", "ст", "сплав", "марка", "гр", "материал", "металл", "мат")

#: Stands for a decimal comma or point inside a word: a code point of the private use area.
DECIMAL_SIGN = "\ue000"

#: Space characters that Java's \s leaves out unless told otherwise are covered by (?U).
SPACES = r"(?U)\s+"


def squeeze_space(col: Column) -> Column:
    """Runs of Unicode white space to one space, outer space removed; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), SPACES, " "))


def twin_fold(col: Column) -> Column:
    """Upper case, Ё as Е, Cyrillic letters with a Latin twin as that twin."""
    return F.translate(F.upper(col), CYRILLIC_TWINS, LATIN_TWINS)


def compact_key(col: Column) -> Column:
    """``twin_fold`` without anything but letters and digits."""
    return F.regexp_replace(twin_fold(col), r"[^\p{L}\p{Nd}]+", "")


def _compatible() -> tuple[str, str]:
    """Signs of the Basic Multilingual Plane that Unicode compatibility composition makes
    one letter or digit of the Latin, Greek or Cyrillic script, and what it makes of them."""
    pairs = []
    for code in range(0x80, 0xFFFF):
        sign = chr(code)
        plain = unicodedata.normalize("NFKC", sign)
        if plain != sign and len(plain) == 1 and plain.isalnum() and ord(plain) < 0x530:
            pairs.append((sign, plain))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_SIGNS, _PLAIN = _compatible()
# Signs that stand for several letters, and letters written with a mark apart.
SEVERAL = {"№": "No", "℃": "°C", "㎜": "mm", "㎝": "cm", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅺ": "XI", "Ⅻ": "XII", "½": "1/2", "¼": "1/4", "¾": "3/4", "и\u0306": "й", "И\u0306": "Й", "е\u0308": "ё", "Е\u0308": "Ё"}


def compatible(col: Column) -> Column:
    """Unicode compatibility composition as far as Latin, Greek and Cyrillic letters and
    digits go; other signs stay. Texts without such signs are only scanned."""
    whole = F.translate(col, _SIGNS, _PLAIN)
    for sign, letters in SEVERAL.items():
        whole = F.replace(whole, F.lit(sign), F.lit(letters))
    return F.when(col.rlike(r"[^\u0000-\u007f\u0400-\u04ff«»°±×–—‘’“”„…₽]"), whole).otherwise(col)


def grade_match_key(col: Column) -> Column:
    """The key by which the catalogue's names are compared: ``compact_key`` after
    ``compatible``, so that full-width, raised or joined signs count as plain ones."""
    return compact_key(compatible(col))


def profile_key(col: Column) -> Column:
    """A profile's name as it is compared: upper case, Ё as Е, single spaces."""
    return F.translate(F.upper(squeeze_space(col)), "Ё", "Е")


def strip_material(col: Column, words: tuple[str, ...] = MATERIAL_WORDS) -> Column:
    """Without one leading material word or abbreviation that a space or point follows."""
    longest_first = "|".join(sorted(words, key=len, reverse=True))
    return F.regexp_replace(col, rf"(?iuU)^[\s\p{{P}}]*(?:{longest_first})(?:\s*\.\s*|\s+)(?=\S)", "")


def word_list(col: Column, *, keep_decimal: bool = False) -> Column:
    """Words (runs of letters, marks and digits) in lower case, in order; null to [].

    ``keep_decimal``: a comma or point between two digits is part of the word and
    both are the same.
    """
    text = F.lower(F.coalesce(col, F.lit("")))
    inner = ""
    if keep_decimal:
        inner = DECIMAL_SIGN
        text = F.regexp_replace(text, r"(?<=\p{Nd})[.,](?=\p{Nd})", inner)
    parts = F.split(text, rf"[^\p{{L}}\p{{M}}\p{{N}}{inner}]+")
    return F.filter(parts, lambda w: w != "")


def bag_key(col: Column) -> Column:
    """The words of a text as a sorted bag in one string: equal for texts that differ
    only in case, white space, punctuation and order of words. A decimal sign counts."""
    return F.array_join(F.array_sort(word_list(col, keep_decimal=True)), " ")
