"""The grade that a hint or a description states, by the first of several rules that applies.

The catalogue's names are looked up by equi-joins; every other rule is a built-in
expression, and the order of the rules is that of one ``coalesce``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortament.functions.profiles import PROFILE_STEMS, PROFILE_WORDS
from sortament.functions.text import grade_match_key, squeeze_space
from sortament.operators.catalog import names_of_grades, singleton_keys
from sortament.operators.find_names import find_names
from sortament.operators.joins import broadcast_if_small
from sortament.session import materialise

UNKNOWN_GRADE = "предпол."
_L = "0-9A-Za-zА-Яа-яЁё"
_B, _E = f"(?<![{_L}_])", f"(?![{_L}_])"
# Spellings that stand for another grade, and one whose letters are shown as Cyrillic.
EQUIVALENTS = {"C17200": "БРБ2", "ALLOY25": "БРБ2", "CUBE2": "БРБ2"}
LAYOUTS = {"A75": "А75"}
# Grades named by letters alone, and how alloys' designations begin.
WHOLE_TOKENS = ("ММ", "МТ", "АМФ", "ХВГ", "ШМТ")
ALLOY_STARTS = "БР|ЛЖМЦ|ЛО|ЛС|Л|ММ|МТ|АМФ|АМГ|Д16|ВТ|ХВГ|ХН|Р"
LEADING_STARTS = r"БР|ЛЖМЦ|ЛО|ЛС|Л|АМФ|АМГ|Д16|ВТ|ХВГ|ХН|Р|\d{1,3}[ХНМТВГСФКЮДРЛАБЦИПЭЧ]"
# Designations that are taken as written although no list confirms them.
UNCONFIRMED = ("70С3", "ЭП847", "42НКД")
# Beginnings of words that cite a standard or state a condition, and words that are no grade.
STANDARD_STARTS = ("ГОСТ", "ОСТ", "ТУ", "DIN", "ASTM", "EN", "AISI", "ДКР", "ДПР", "МЯГК", "ТВЕРД", "КАЛИБР", "СЕРЕБРЯНК", "ЗАКАЗ", "МЕХ", "МКК", "УЗК", "ДЛ")
FASTENERS = ("БОЛТ", "ВИНТ", "ГАЙКА", "ШАЙБА", "ШПИЛЬКА")
UNCONFIRMED_NOTE = "Обозначение явно указано поставщиком, но нормативное соответствие пока не подтверждено"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    value = F.regexp_extract(text, pattern, group)
    return F.when(value != "", value)


def _upper(text: Column) -> Column:
    return F.translate(F.upper(text), "Ё", "Е")


def known_names(grades: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, known): keys that lead to one grade only, and its canonical name."""
    named = names_of_grades(grades, aliases).join(grades.select("grade_id", "canonical").dropDuplicates(["grade_id"]), "grade_id")
    keyed = named.select(grade_match_key(F.col("name")).alias("key"), "canonical").where("key <> '' and canonical is not null").distinct()
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("canonical").alias("known")).where("n = 1").select("key", "known")


def normalise_grades(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``rows`` with ``grade`` and ``grade_comments`` for a grade as typed.

    Blank is UNKNOWN_GRADE. A state of delivery after АВ and what follows CU-ETP go into a
    comment. A name of the catalogue is its canonical spelling, a spelling of EQUIVALENTS
    the grade it stands for; anything else is shown in upper case. The comment keeps the
    supplier's spelling where it is another. ``names``: see ``known_names``."""
    raw = F.regexp_replace(squeeze_space(F.col(column)), r"^[\[\];,\s]+|[\[\];,\s]+$", "")
    keyed = rows.withColumn("_raw", raw).withColumn("_plain", F.regexp_replace("_raw", r"^[()]+|[()]+$", "")).withColumn("key", grade_match_key(F.col("_plain")))
    joined = keyed.join(broadcast_if_small(names), "key", "left")
    upper = _upper(F.col("_plain"))
    state = _upper(F.col("_raw")).rlike(r"^(?:АВ|AB)[.\s_-]*[ТT]1$")
    copper = _upper(F.col("_raw")).rlike(r"^CU-ETP(?:\s|$)")
    suffix = F.trim(F.regexp_replace(_upper(F.col("_raw")), "^CU-ETP", ""))
    table = F.create_map(*[F.lit(x) for pair in (EQUIVALENTS | LAYOUTS).items() for x in pair])
    mapped = F.coalesce(F.try_element_at(table, F.regexp_replace(upper, r"[\s_-]+", "")), F.try_element_at(table, F.col("key")))
    grade = F.when(F.col("_raw") == "", UNKNOWN_GRADE).when(state, "АВ").when(copper, "CU-ETP").otherwise(F.coalesce("known", mapped, upper))
    source = F.concat(F.lit("Исходное обозначение поставщика: "), F.when(state, F.col("_raw")).otherwise(F.col("_plain")))
    comments = F.array_compact(
        F.array(
            F.when(state, "Состояние поставки: Т1"), F.when(copper & (suffix != ""), F.concat(F.lit("Дополнительное обозначение марки: "), suffix)),
            F.when((F.col("_raw") != "") & ~copper & (state | (_upper(grade) != upper) | (grade != upper)), source),
        )
    )
    return joined.withColumn("grade", grade).withColumn("grade_comments", comments).drop("_raw", "_plain", "key", "known")


def _after_profile(text: Column, profile: Column) -> Column:
    """What follows the first word of a row's own profile; the text where it names none."""
    rest = text
    for name, stems in PROFILE_STEMS.items():
        word = rf"(?iu)^.*?{_B}(?:{'|'.join(stems)})[{_L}]*"
        rest = F.when((profile == name) & text.rlike(word), F.regexp_replace(text, word, "")).otherwise(rest)
    return rest


def _leading_grade(rest: Column, profile: Column) -> Column:
    """The token after the profile where it looks like a designation and not like a size."""
    token = _found(rest, rf"^\s*([{_L}-]+)")
    up = _upper(token)
    size = up.rlike(r"\d\s*[XХ×*]\s*\d") | up.rlike(r"^[DДN№]\d") | (profile.isin(*FASTENERS) & up.rlike(r"^М\d"))
    number = up.rlike(r"^\d+$")
    plain = token.isin("10", "20") & ~F.substring(rest, 1, 20).rlike("[×*]")
    return F.when(F.when(size, False).when(number, plain).otherwise(up.isin(*WHOLE_TOKENS) | up.rlike(f"^(?:{LEADING_STARTS})")), token)


def _crossed_grade(text: Column) -> Column:
    """The last designation with an Х after one to three digits, such as 12Х18Н10Т; digits
    on both sides of it alone are a size, unless the text marks its size otherwise."""
    every = F.regexp_extract_all(text, F.lit(rf"(?<![{_L}_.,])(\d{{1,3}}[ХхXx][{_L}-]+)"), F.lit(1))
    marked = text.rlike(r"(?iu)[ØФД]\s*[=:.-]?\s*\d|[№N]\s*0*\d") | text.rlike(r"\d\s*[×*]\s*\d")
    real = F.filter(every, lambda c: ~c.rlike(r"^\d+(?:[.,]\d+)?[ХхXx]\d+(?:[.,]\d+)?$") & (F.regexp_replace(c, r"^\d+[ХхXx]", "").rlike("[A-Za-zА-Яа-я]") | marked))
    return F.try_element_at(real, F.lit(-1))


def _alloy_token(text: Column) -> Column:
    """The first word that begins like an alloy and is neither a profile nor a standard."""
    forms = "|".join(sorted({s for stems in PROFILE_STEMS.values() for s in stems} | {w for ws in PROFILE_WORDS.values() for w in ws}, key=lambda s: (-len(s), s)))
    tokens = F.regexp_extract_all(F.regexp_replace(text, rf"(?iu){_B}(?:{forms})[{_L}]*", " "), F.lit(rf"{_B}[{_L}-]{{1,30}}{_E}"), F.lit(0))
    standard = lambda t: reduce(Column.__or__, [_upper(t).startswith(s) for s in STANDARD_STARTS])
    good = F.filter(tokens, lambda t: ~standard(t) & (_upper(t).isin(*WHOLE_TOKENS) | _upper(t).rlike(f"^(?:{ALLOY_STARTS})[A-ZА-Я0-9-]*$")))
    return F.get(good, F.lit(0))


def _alternatives(text: Column) -> Column:
    """Comments on what stands in brackets, but for amounts and least quantities."""
    inside = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]{2,40})\)"), F.lit(1)), lambda p: F.trim(p))
    service = lambda p: F.upper(p).rlike(r"^МИН\.?|^МИНИМУМ") | F.upper(p).rlike(r"^\d+(?:[.,]\d+)?\s*(?:КГ|М|ММ|ШТ\.?)$")
    kept = F.filter(inside, lambda p: p.rlike("[A-Za-zА-Яа-я]") & ~service(p))
    return F.transform(kept, lambda p: F.concat(F.lit("Альтернативное обозначение: "), p))


def grades_in_text(rows: DataFrame, key: str, text: str, profile: str, grades: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, grade, rule, comments): the grade that each text states, the rule that found
    it, and what else the text says of grades.

    Rules in their order: the aluminium alloy 1340; two grades in one notation, as in
    08(12)Х18Н10Т, if the catalogue has both; the first of the catalogue's names in the
    text; classes of fasteners; AISI; ст.; an alloy's letters and numbers apart; the token
    after the profile; a designation with Х; Х and digits after a size; words that begin
    like an alloy; designations taken as written. Else UNKNOWN_GRADE by the rule NONE. A
    null text or profile is a blank one; a repeated key is read once for each row.
    """
    names = materialise(known_names(grades, aliases))
    numbered = materialise(rows.select(F.col(key).alias("key"), squeeze_space(F.col(text)).alias("text"), F.coalesce(F.col(profile), F.lit("")).alias("profile"), F.monotonically_increasing_id().alias("row")))
    listed = names_of_grades(grades, aliases).join(grades.select("grade_id", "canonical").dropDuplicates(["grade_id"]), "grade_id").select(F.col("canonical").alias("name_id"), "name")
    places = find_names(numbered, "row", "text", listed).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "name_id"))).alias("m"))  # the names in one text
    read = numbered.join(places, "row", "left")
    t, p = F.col("text"), F.col("profile")
    aluminium = t.rlike(r"(?iu)СПЛАВ\s+АЛЮМ") & t.rlike(r"\(\s*1340\s*\)") & t.rlike(rf"(?iu){_B}АВ(?:[.\s-]*Т1)?{_E}")
    both = rf"(?<![0-9А-ЯA-Z])(\d{{2}})\((\d{{2}})\)([ХхXx][{_L}-]+)"
    tail = F.translate(F.upper(_found(t, both, 3)), "X", "Х")
    read = read.withColumn("first", F.concat(_found(t, both, 1), tail)).withColumn("second", F.concat(_found(t, both, 2), tail))
    for end in ("first", "second"):
        at = names.select(F.col("key").alias(f"_{end}"), F.col("known").alias(f"known_{end}"))
        read = read.withColumn(f"_{end}", grade_match_key(F.col(end))).join(broadcast_if_small(at), f"_{end}", "left")
    pair = F.col("known_first").isNotNull() & F.col("known_second").isNotNull()
    rest = _after_profile(t, p)
    apart = r"(?iu)^\s*(БР[А-ЯA-Z]+|ЛЖМЦ|АМФ|АМГ|ШМТ|ММ|МТ|ХВГ)\s+(\d+(?:[.,]\d+)?(?:-\d+(?:[.,]\d+)?)+)"
    plain_size = r"(?:[ØФфДд]\s*[=:.-]?\s*\d+(?:[.,]\d+)?|\d+(?:[.,]\d+)?(?:\s*[×*]\s*\d+(?:[.,]\d+)?)+)"
    taken = F.coalesce(*[F.when(_upper(t).rlike(f"(?<![0-9A-ZА-Я]){d}(?![0-9A-ZА-Я])"), d) for d in UNCONFIRMED])
    rules = {
        "ALUMINIUM_1340": F.when(aluminium, "АВ"),
        "TWO_GRADES": F.when(pair, F.col("known_first")),
        "CATALOGUE": F.get("m", F.lit(0))["name_id"],
        "FASTENER": F.when(p.isin(*FASTENERS), _found(t, rf"(?iu){_B}([AА][24]-\d{{2}}){_E}")),
        "AISI": _found(t, rf"(?iu){_B}(AISI\s*\d{{3}}[A-Z]?){_E}"),
        "STEEL": _found(t, rf"(?iu){_B}ст\.?\s*(\d{{1,3}}[{_L}-]*)"),
        "APART": F.concat(_found(rest, apart, 1), _found(rest, apart, 2)),
        "LEADING": _leading_grade(rest, p),
        "CROSSED": _crossed_grade(t),
        "AFTER_SIZE": _found(t, rf"{plain_size}.*?{_B}([ХхXx]\d{{1,3}}){_E}"),
        "ALLOY": _alloy_token(t),
        "AS_WRITTEN": taken,
    }
    chosen = F.coalesce(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("rule"), v.alias("said"))) for n, v in rules.items()], F.struct(F.lit("NONE").alias("rule"), F.lit("").alias("said")))
    others = F.transform(F.filter(F.array_distinct(F.transform("m", lambda x: x["name_id"])), lambda n: n != F.get("m", F.lit(0))["name_id"]), lambda n: F.concat(F.lit("Альтернативная марка: "), n))
    extra = (
        F.when(F.col("c.rule") == "ALUMINIUM_1340", F.array_compact(F.array(F.lit("Цифровое обозначение сплава: 1340"), F.when(t.rlike(rf"(?iu){_B}АВ[.\s-]*Т1{_E}"), "Состояние поставки: Т1"))))
        .when(F.col("c.rule") == "TWO_GRADES", F.array(F.concat(F.lit("Альтернативная марка: "), "known_second")))
        .when(F.col("c.rule") == "CATALOGUE", others)
        .when(F.col("c.rule") == "AS_WRITTEN", F.array(F.lit(UNCONFIRMED_NOTE)))
        .otherwise(F.array().cast("array<string>"))
    )
    found = read.withColumn("c", chosen).withColumn("comments", F.concat(_alternatives(t), extra)).select("row", F.col("key").alias("_key"), F.col("c.rule").alias("rule"), F.col("c.said").alias("said"), "comments")
    # A spelling from the text goes the way of a typed one.
    named = normalise_grades(found, "said", names)
    return named.select(F.col("_key").alias(key), "grade", "rule", "comments")


__all__ = ["grades_in_text", "known_names", "normalise_grades", "singleton_keys"]
