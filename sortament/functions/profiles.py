"""Profiles, materials and domains that a text names, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Profiles in the order in which they are tried, and how their words begin.
PROFILE_STEMS = {
    "ТРУБА": ("труб",), "ЛИСТ": ("лист",), "ПЛИТА": ("плит",), "КРУГ": ("круг",), "ПРУТОК": ("прут",), "ПРОВОЛОКА": ("проволок",),
    "ЛЕНТА": ("лент",), "ПОЛОСА": ("полос",), "КВАДРАТ": ("квадрат",), "ШЕСТИГРАННИК": ("шестигран",), "ПОКОВКА": ("поковк",),
    "УГОЛОК": ("угол",), "ШВЕЛЛЕР": ("швеллер",), "АНОД": ("анод",), "КАТОД": ("катод",), "ФОЛЬГА": ("фольг",), "ШИНА": ("шин",),
    "ГРАНУЛЫ": ("гранул",), "ВТУЛКА": ("втулк",), "ДИСК": ("диск",), "КОЛЬЦО": ("кольц",), "ПРОВОДНИК": ("проводник",), "СЕТКА": ("сетк",),
    "ОТВОД": ("отвод",), "ТРОЙНИК": ("тройник",), "ПЕРЕХОД": ("переход",), "ФЛАНЕЦ": ("флан",), "БОЛТ": ("болт",), "ВИНТ": ("винт",),
    "ГАЙКА": ("гайк",), "ШАЙБА": ("шайб",), "ШПИЛЬКА": ("шпильк",), "ЭЛЕКТРОД": ("электрод",), "ЗАГОТОВКА": ("заготовк",),
    "СЛИТОК": ("слит",), "ШИХТА": ("шихт",), "ЛОМ": ("лом",),
}
# Further words that name a form of goods in price lists.
OTHER_FORM_STEMS = {"БАЛКА": ("балк",), "ПРОФИЛЬ": ("профил",), "ШТРИПС": ("штрипс",), "РУЛОН": ("рулон",)}
# How the words of a profile end.
WORD_ENDINGS = r"(?:[аеиоуыйяь]|о?к[аи]?|ник[аи]?|н?ец|н?ц[аыу]|ок|ов|ев|ей|ам[иь]?)?"
# Round bars go by either name in a search.
ROUND_BARS = ("КРУГ", "ПРУТОК")
UNKNOWN_PROFILE = "НЕ ОПРЕДЕЛЁН"
# Forms of the nouns that state a material.
MATERIALS = {
    "ТИТАН": "титан(?:а|у|ом|е)?", "МЕДЬ": "мед(?:ь|и|ью)", "ЛАТУНЬ": "латун(?:ь|и|ью)", "БРОНЗА": "бронз(?:а|ы|е|ой)",
    "АЛЮМИНИЙ": "алюмини(?:й|я|ю|ем|и)", "НИКЕЛЬ": "никел(?:ь|я|ю|ем|е)", "СТАЛЬ": "стал(?:ь|и|ью)",
}
_LETTER = "[0-9A-Za-zА-Яа-яЁё]"

#: Every beginning of a word that names a form, longest first, with the form's name.
FORM_STEMS = {
    stem: name
    for stem, name in sorted(((s, n) for n, stems in {**PROFILE_STEMS, **OTHER_FORM_STEMS}.items() for s in stems), key=lambda x: (-len(x[0]), x[0]))
}


def _begins(text: Column, stem: str) -> Column:
    return text.rlike(rf"(?<!{_LETTER}|_){stem}")


def profile_of(text: Column) -> Column:
    """The profile a text names: the first of PROFILE_STEMS, in their order, with a word
    of it; else the first token in upper case; else UNKNOWN_PROFILE."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е")
    named = [F.when(reduce(Column.__or__, [_begins(low, s) for s in stems]), F.lit(name)) for name, stems in PROFILE_STEMS.items()]
    token = F.upper(F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)\S+", 0), r"^[.,:;()\[\]]+|[.,:;()\[\]]+$", ""))
    return F.coalesce(*named, F.when(token != "", token), F.lit(UNKNOWN_PROFILE))


def search_profiles(profile: Column) -> Column:
    """The profiles a search for one accepts."""
    return F.when(profile.isin(*ROUND_BARS), F.array(*[F.lit(p) for p in ROUND_BARS])).otherwise(F.array(profile))


def material_of(text: Column) -> Column:
    """The material whose noun a text states, the first of MATERIALS; else null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(rf"(?<!{_LETTER}){form}(?!{_LETTER})"), F.lit(name)) for name, form in MATERIALS.items()])


def domain_of(description: Column, profile: Column) -> Column:
    """METAL_PRODUCT, FERROUS_SCRAP, NONFERROUS_SCRAP or WELDING_CONSUMABLE."""
    text = F.translate(F.upper(F.coalesce(description, F.lit(""))), "Ё", "Е")
    scrap = profile.isin("ЛОМ", "ШИХТА")
    nonferrous = text.rlike("(?<![А-ЯA-Z0-9])(?:МЕДН|ЛАТУН|БРОНЗ|АЛЮМИН|СВИНЕЦ|ЦИНК|ТИТАН)")
    code = text.rlike(r"(?<![А-ЯA-Z0-9])(?:E\d{3}|ER\d{3}|СВ[-\s]?\d)")
    welding = (profile.isin("ЭЛЕКТРОД", "ПРОВОЛОКА") & code) | text.rlike(r"СВАРОЧН|ПОРОШКОВАЯ\s+ПРОВ")
    return F.when(scrap & nonferrous, "NONFERROUS_SCRAP").when(scrap, "FERROUS_SCRAP").when(welding, "WELDING_CONSUMABLE").otherwise("METAL_PRODUCT")


def is_service_line(text: Column, has_numbers: Column) -> Column:
    """Totals, headings and numbered sections of a price list rather than goods; a line
    of two or more words with numeric cells is goods."""
    plain = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    service = (plain == "") | plain.rlike("^(?:итого|всего|наименование|склад|прайс-лист|цены оптовые)(?![а-яёa-z0-9])") | plain.rlike(r"^\d+(?:\.\d+)*\s+[^0-9]*$")
    words = F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))
    return service & ~(has_numbers & (words >= 2))


# Whole words by which a name states its profile, in the order in which they are tried.
PROFILE_WORDS = {
    "ПРУТОК": ("пруток", "прутки"), "КРУГ": ("круг", "круги", "круглый"), "ТРУБА": ("труба", "трубка", "трубки"), "ПРОВОЛОКА": ("проволока", "проволоки"),
    "ЛИСТ": ("лист", "листы"), "ПЛИТА": ("плита", "плиты"), "ПОЛОСА": ("полоса", "полосы"), "ЛЕНТА": ("лента", "ленты"), "КВАДРАТ": ("квадрат", "квадраты"),
    "ШЕСТИГРАННИК": ("шестигранник", "шестигранники"), "КОЛЬЦО": ("кольцо", "кольца"), "ПОКОВКА": ("поковка", "поковки"),
}


def plain_profile_word(text: Column) -> Column:
    """The profile that a name states by a whole word, the first of PROFILE_WORDS; else null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(rf"(?<!{_LETTER}|_)(?:{'|'.join(words)})(?!{_LETTER}|_)"), F.lit(name)) for name, words in PROFILE_WORDS.items()])
