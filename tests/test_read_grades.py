import pytest

from sortament.operators.read_grades import grades_in_text, known_names, normalise_grades

GRADES = [("g1", "12Х18Н10Т"), ("g2", "08Х18Н10Т"), ("g3", "БРБ2"), ("g4", "ХН60ВТ"), ("g5", None)]
ALIASES = [("a1", "ЭИ868", "g4", "CONFIRMED"), ("a2", "OLD1", "g1", "REJECTED")]


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(GRADES, "grade_id string, canonical string"), spark.createDataFrame(ALIASES, "alias_id string, alias string, canonical_grade_id string, status string")


def test_typed_grades(spark, lists):
    cases = {
        "": ("предпол.", []), None: ("предпол.", []), "АВ-Т1": ("АВ", ["Состояние поставки: Т1", "Исходное обозначение поставщика: АВ-Т1"]), "cu-etp R250": ("CU-ETP", ["Дополнительное обозначение марки: R250"]),
        "CU-ETP": ("CU-ETP", []), "12x18h10t": ("12Х18Н10Т", ["Исходное обозначение поставщика: 12x18h10t"]), "12Х18Н10Т;": ("12Х18Н10Т", []), "ЭИ868": ("ХН60ВТ", ["Исходное обозначение поставщика: ЭИ868"]),
        "Alloy 25": ("БРБ2", ["Исходное обозначение поставщика: Alloy 25"]), "а75": ("А75", []), "ёж1": ("ЕЖ1", []), "OLD1": ("OLD1", []),
    }
    df = spark.createDataFrame([(i, c, "x") for i, c in enumerate(cases)], "id int, typed string, profile string")
    got = {r.id: (r.grade, list(r.grade_comments)) for r in normalise_grades(df, "typed", known_names(*lists)).collect()}
    assert {c: got[i] for i, c in enumerate(cases)} == cases


def test_grades_in_text(spark, lists):
    cases = [
        ("Лист сплав алюм. (1340) АВ-Т1 2х1200", "ЛИСТ", "АВ", "ALUMINIUM_1340"), ("Труба 08(12)Х18Н10Т 20х2", "ТРУБА", "08Х18Н10Т", "TWO_GRADES"), ("Круг ЭИ868 (12Х18Н10Т) ф20", "КРУГ", "ХН60ВТ", "CATALOGUE"),
        ("Болт М12х75 A2-70 DIN 933", "БОЛТ", "A2-70", "FASTENER"), ("Труба AISI 304L 20х2", "ТРУБА", "AISI 304L", "AISI"), ("Квадрат ст.20 100", "КВАДРАТ", "20", "STEEL"),
        ("Лента БРОФ 6,5-0,15 0,3х200", "ЛЕНТА", "БРОФ6,5-0,15", "APART"), ("Труба М1 12х1", "ТРУБА", "предпол.", "NONE"), ("Пруток Л63 № 7", "ПРУТОК", "Л63", "LEADING"), ("Пруток 40Х13 ф30", "ПРУТОК", "предпол.", "NONE"), ("Пруток 40Х13Н ф30", "ПРУТОК", "40Х13Н", "CROSSED"),
        ("ф30 поковка 95Х18-Ш", "ПОКОВКА", "95Х18-Ш", "CROSSED"), ("Лист 10х20", "ЛИСТ", "предпол.", "NONE"), ("ф200 L=300 Х12 поковка", "ПОКОВКА", "Х12", "AFTER_SIZE"), ("0,5х20 серебрянка ВТ6 лист", "ЛИСТ", "ВТ6", "ALLOY"),
        ("проволока 2 ЭП847", "ПРОВОЛОКА", "ЭП847", "AS_WRITTEN"), ("", "", "предпол.", "NONE"), (None, None, "предпол.", "NONE"), ("слово " * 4000, "ЛИСТ", "предпол.", "NONE"),
    ]
    df = spark.createDataFrame([(i, t, p, "x") for i, (t, p, _, _) in enumerate(cases)] + [(100, "Пруток Л63 № 7", "ПРУТОК", "x")], "id int, text string, profile string, grade string")
    found = grades_in_text(df, "id", "text", "profile", *lists).collect()
    got = {r.id: (r.grade, r.rule) for r in found}
    assert {cases[i][0]: got[i] for i in range(len(cases))} == {t: (g, r) for t, _, g, r in cases} and len(found) == len(cases) + 1
    notes = {r.id: list(r.comments) for r in found}
    assert notes[1] == ["Альтернативная марка: 12Х18Н10Т"] and notes[2] == ["Альтернативное обозначение: 12Х18Н10Т", "Альтернативная марка: 12Х18Н10Т"]
    assert notes[0] == ["Цифровое обозначение сплава: 1340", "Состояние поставки: Т1"]
    assert grades_in_text(df.where("false"), "id", "text", "profile", *lists).count() == 0
