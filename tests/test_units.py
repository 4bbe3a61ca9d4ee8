from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sortament.operators.units import InconsistentUnits, UnitGraph, common_units, conversion_table, stated_amount, unknown_units
from tests.conftest import rows

TEXTS = {
    "7 км": ("7", "км"), "≈ 2 793,5 пог.м": ("2793.5", "погм"), "1'689штук": ("1689", "штук"), "остаток, тыс.шт. — 30,3": ("30.3", "тысшт"),
    "яч. 18, 30 т": ("30", "т"), "яч. 31, 2'016.2 кг.": ("2016.2", "кг"), "склад №9: 4296,7 kg": ("4296.7", "kg"), "от 5 дн.; 1937 метров": ("1937", "метров"),
    "(кг) 7476,3": ("7476.3", "кг"), "КГ: 2009": ("2009", "кг"), "491 м. (резерв возможен)": ("491", "м"), "24t": ("24", "t"), "15,4 тыс. штук": ("15.4", "тысштук"),
    "329": (None, None), "склад №3": (None, None), "по запросу": (None, None), "": (None, None), "5 килограммчиков": (None, None),
}


def test_stated_amounts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", stated_amount(F.col("t")).alias("s"))
    got = {r.t: (r.s.amount, r.s.unit if r.s.amount is not None else None) for r in df.collect()}
    assert got == {t: (Decimal(a) if a else None, u) for t, (a, u) in TEXTS.items()}


def test_outer_unit(spark):
    df = spark.createDataFrame([("28", "тн."), ("28 кг", "тн."), ("склад №3", "кг"), ("~5,5", None)], "t string, u string")
    got = [tuple(r[0]) for r in df.select(stated_amount(F.col("t"), F.col("u"))).collect()]
    assert got[:2] == [(Decimal(28), "тн"), (Decimal(28), "кг")] and got[2][0] is None and got[3][1] is None


def test_graph():
    graph = UnitGraph.of()
    assert graph.to("g")["t"].scale == 1_000_000 and graph.to("um")["in"].scale == 25400 and graph.to("mm")["ft"].scale == Fraction("304.8")
    assert "kg" not in graph.to("mm")


def test_affine_and_cycles():
    warm = UnitGraph.of([("c", "k", "1", "273.15"), ("f", "c", "5/9", "-160/9"), ("f", "k", "5/9", str(Fraction("273.15") - Fraction(160, 9)))])
    f = warm.to("k")["f"]
    assert f.scale * 212 + f.shift == Fraction("373.15")
    with pytest.raises(InconsistentUnits):
        UnitGraph.of([("a", "b", "2", "0"), ("b", "c", "3", "0"), ("a", "c", "7", "0")]).to("c")
    with pytest.raises(InconsistentUnits):
        UnitGraph.of([("a", "b", "0", "0")])
    with pytest.raises(InconsistentUnits):
        UnitGraph.of([("a", "b", "2", "0"), ("a", "b", "3", "0")])


def test_table_has_each_spelling_once(spark):
    table = conversion_table(spark, ("g", "mm", "pcs"))
    assert table.count() == table.select("spelling").distinct().count()


OFFERS = "offer_id long, quantity_value decimal(18,6), quantity_unit string, availability string, dim1 decimal(18,6), dim1_unit string, unit string"
ITEMS = "item_id long, availability string, extra_json string"


def test_common_units(spark):
    d = Decimal
    offers = spark.createDataFrame(
        [
            (1, d("1.5"), "т", "3 кг", d("4.094488"), "INCH", "x"), (2, d("1.5"), None, "3,0005 кг", d("2"), None, "x"), (3, None, "т", "5 lb", None, "мм", "x"),
            (4, d("7"), " ", None, d("0.0715"), "м", "x"), (5, d("7"), "бочка", "5 кг", None, None, "x"), (6, None, None, "2 ц", None, None, "x"), (6, None, None, "2 ц", None, None, "x"),
        ],
        OFFERS,
    )
    items = spark.createDataFrame([(1, "28", '{"availability_unit": "тн."}'), (2, "1 ft", None), (3, None, None), (4, "9", "no json")], ITEMS)
    got = rows(common_units(offers, items).distinct())
    assert got == sorted(
        [
            ("offers", 1, "quantity", "g", 1_500_000), ("offers", 1, "dim1", "um", 104_000), ("offers", 2, "quantity", "g", 3001), ("offers", 3, "quantity", "g", 2268),
            ("offers", 4, "dim1", "um", 71_500), ("offers", 6, "quantity", "g", 200_000), ("raw_items", 1, "quantity", "g", 28_000_000), ("raw_items", 2, "quantity", "mm", 305),
        ],
        key=repr,
    )
    assert common_units(offers.where("false"), items.where("false")).count() == 0


def test_unknown_units(spark):
    df = spark.createDataFrame([(1, "бочка"), (2, "бочка"), (3, "кг"), (4, None)], "amount int, unit string")
    assert rows(unknown_units(df, "amount", "unit")) == [("бочка", 2)]
