"""Profile, designation and sizes that a description states.

The description of one position is a short text in free order, so this is one scan in
Python over Arrow batches; everything around it are built-in expressions.
"""

from __future__ import annotations

import re

from sortament.functions.profiles import FORM_STEMS, WORD_ENDINGS

# Micrometres in a unit.
MICROMETRES = {
    "мм": 1e3, "mm": 1e3, "см": 1e4, "cm": 1e4, "м": 1e6, "m": 1e6, "дюйм": 25400.0, "in": 25400.0, "inch": 25400.0,
}

# Bodies whose standards are cited with a number, and words of a time of delivery.
STANDARDS = ("гост", "ост", "ту", "стп", "сто", "din", "astm", "asme", "iso", "en", "ams")
DELIVERY = r"(?:дн(?:ей|я|ь)?|недел[ьяию]|нед|мес(?:яц\w*)?|days?|weeks?)"

_PROFILE = re.compile(rf"(?<!\w)({'|'.join(FORM_STEMS)}){WORD_ENDINGS}(?!\w)")
_NOISE = re.compile(rf"(?<!\w)(?:{'|'.join(STANDARDS)})\s*(?:р\s*)?\d[\d.–-]*\d(?![\w-])|(?<![\w-])\d+(?:-\d+)?\s+{DELIVERY}\.?(?!\w)")
_NUM = r'(?:\d+\.\d+/\d+"|\d+/\d+"|\d+"|\d+(?:[.,]\d+)?)'
_BY = r"\s*[xх×*]\s*"
_SIZE = re.compile(
    rf"(?<![\w.,/-])(?:(s|l|раскрой|длина|дл|диам|сторона|ф|ø|d)(?:\.|=|\s)*\s*)?({_NUM}(?:{_BY}{_NUM}){{0,2}})\s*(мм|mm|см|cm|м|m)?(?![\w/-]|[.,]\d)"
)
_SPLIT = re.compile(_BY)
#: A designation: a name with a number and letter after a space, or a run of letters and
#: digits, both at least once, with parts after a hyphen or, between digits, a slash.
_GRADE = re.compile(r"(?<!\w)(?:[a-z]{3,}\s+\d{2,}[a-z]|(?=[\w-]*\d)(?=[\d_-]*[^\W\d_])\w+(?:-\w+|(?<=\d)/\d+)*)(?!\w)")


def _micrometres(number: str, unit: str | None) -> int:
    if number[-1] != '"':
        return round(float(number.replace(",", ".")) * MICROMETRES[unit or "мм"])
    whole, _, part = number[:-1].rpartition(".")
    top, _, bottom = part.partition("/")
    inches = int(top) / int(bottom) if bottom and int(bottom) else int(top)
    return round((int(whole or 0) + inches) * 25400)


def read_product(text: str) -> tuple[str | None, str | None, list[int]]:
    """(profile, designation as written, sizes in micrometres) that one position states."""
    plain = _NOISE.sub(" ", text.lower())
    named = _PROFILE.search(plain)
    first = length = None
    sheet: list[int] = []
    several: list[int] = []
    single: list[int] = []
    for label, body, unit in _SIZE.findall(plain):
        values = [_micrometres(n, unit) for n in _SPLIT.split(body)]
        if label in ("l", "дл", "длина") and len(values) == 1:
            length = values[0]
        elif label == "раскрой":
            sheet = values
        elif label == "s" and len(values) == 1:
            first = values[0]
        elif len(values) > 1:
            several += values
        else:
            single += values
    if sheet:  # thickness, then the blank's sides
        sizes = ([first] if first is not None else []) + several + single + sheet
    else:
        sizes = ([first] if first is not None else []) + several + sorted(single)
    if length is not None:
        sizes.append(length)
    grade = _GRADE.search(_SIZE.sub(" ", plain))
    return FORM_STEMS[named[1]] if named else None, grade[0] if grade else None, sizes
