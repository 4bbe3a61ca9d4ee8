from decimal import Decimal as D

from sortament.operators.read_sizes import sizes_in_text

CASES = [
    ("Пруток C17200 20х2000", "ПРУТОК", "C17200", ("20", "2000", None), "SEQUENCE", []), ("Труба 12Х18Н10Т 5х1,5", "ТРУБА", None, ("5", "1.5", None), "TUBE", []),
    ("Лента БРОФ 0,3х200", "ЛЕНТА", None, ("0.3", "200", None), "SEQUENCE", []), ("Полоса 6х30х4000х2", "ПОЛОСА", None, ("6", "30", "4000"), "SEQUENCE", ["FOURTH_SIZE"]),
    ("Проводник OD 12х10 ID 6,5", "ПРОВОДНИК", None, ("12", "10", "6.5"), "CONDUCTOR", ["OUTER_SECTION_AND_CHANNEL"]), ("Лист диск 10*д240", "ЛИСТ", None, ("10", "240", None), "DISC", ["PROFILE_TO_BE_DECIDED"]),
    ("Фланец Ду100 Ру16", "ФЛАНЕЦ", None, ("100", None, None), "FLANGE", ["NOMINAL_SIZE"]), ("Сетка П48 шир. 1000", "СЕТКА", None, ("1000", None, None), "MESH", ["WIDTH"]),
    ("Шестигранник S32", "ШЕСТИГРАННИК", None, ("32", None, None), "ACROSS_FLATS", ["SIZE_TO_BE_DECIDED"]), ("Плита 40хд500/д300", "ПЛИТА", None, ("40", "500", "300"), "RING", ["PROFILE_TO_BE_DECIDED"]),
    ("Пруток ДКРПТ 16хНД", "ПРУТОК", None, ("16", None, None), "RANDOM_LENGTH", ["RANDOM_LENGTH"]), ("Труба 42х2.5 М1", "ТРУБА", None, ("42", "2.5", None), "TUBE", []), ("Труба М1 ф70*17.5", "ТРУБА", None, ("70", "17.5", None), "TUBE_DIAMETER", []),
    ("Труба нерж 7/8 дюйма", "ТРУБА", None, ("0.875", None, None), "TUBE_INCHES", ["INCHES"]), ("Болт М12х75", "БОЛТ", None, ("12", "75", None), "THREAD", []), ("Гайка М16", "ГАЙКА", None, ("16", None, None), "THREAD_ALONE", []),
    ("Труба OD 10 ID 8 длина 300", "ТРУБА", None, ("10", "1", "300"), "TUBE_OUTER_INNER", ["WALL_COMPUTED"]), ("Труба OD=8 ID=10", "ТРУБА", None, ("8", None, None), "TUBE_OUTER_INNER", ["INNER_NOT_BELOW_OUTER"]),
    ("Круг ф46х11480", "КРУГ", None, ("46", "11480", None), "DIAMETER_PAIR", []), ("Круг ф40 L=500", "КРУГ", None, ("40", "500", None), "DIAMETER", []), ("Пруток Л63 № 08", "ПРУТОК", None, ("8", None, None), "SECTION_NUMBER", []),
    ("Круг 25 мм", "КРУГ", None, ("25", None, None), "MILLIMETRES", []), ("Проволока ф2,5", "ПРОВОЛОКА", None, ("2.5", None, None), "DIAMETER", []), ("Квадрат № 12", "КВАДРАТ", None, ("12", None, None), "SECTION_NUMBER", []),
    ("Отвод 108х4", "ОТВОД", None, ("108", "4", None), "SEQUENCE", ["ORDER_OF_SOURCE"]), ("Переход 108х4 - 57х3", "ПЕРЕХОД", None, ("108", "4", None), "SEVERAL_SETS", ["SEVERAL_SETS"]), ("Лист 0,8х980х1350-1500", "ЛИСТ", None, ("0.8", "980", "1350"), "SEQUENCE", []),
    ("Лом меди", "ЛОМ", None, (None, None, None), "NONE", []), (None, None, None, (None, None, None), "NONE", []), ("", "КРУГ", None, (None, None, None), "NONE", []), ("слово " * 5000, "КРУГ", "слово", (None, None, None), "NONE", []),
]


def test_sizes(spark):
    df = spark.createDataFrame([(i, t, p, g, "x") for i, (t, p, g, *_) in enumerate(CASES)], "id int, text string, profile string, grade string, rule string")
    got = {r.id: r for r in sizes_in_text(df, "id", "text", "profile", "grade").collect()}
    for i, (text, _, _, sizes, rule, notes) in enumerate(CASES):
        r = got[i]
        want = tuple(D(s) if s else None for s in sizes)
        assert ((r.dim1, r.dim2, r.dim3), r.rule, r.notes) == (want, rule, notes), text
    shown = got[[c[0] for c in CASES].index("Лист 0,8х980х1350-1500")]
    assert (shown.display1, shown.display2, shown.display3) == (None, None, "1350-1500")
    assert sizes_in_text(df.where("false"), "id", "text", "profile").count() == 0
