from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from sortament.functions import values as v
from sortament.functions.text import compact_key, compatible, grade_match_key
from sortament.operators import listing
from tests.conftest import rows


def one(spark, column, *data):
    df = spark.createDataFrame([(x,) for x in data], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_numbers_and_amounts(spark):
    assert one(spark, v.number_text, "20", "2.500", "0.10", "-3.0", "100", None) == ["20", "2.5", "0.1", "-3", "100", None]
    assert one(spark, v.typed_number, "1,5", " 2.25 ", "x", None)[:2] == [D("1.5"), D("2.25")]
    assert one(spark, lambda c: v.availability_text(c, F.lit("кг")), "28,9", "5 т", "", None, " под   заказ ") == ["28.9 кг", "5 т", "", "", "под заказ"]
    assert one(spark, lambda c: v.availability_text(c, F.lit(None).cast("string")), "28,9") == ["28,9"]
    assert one(spark, lambda c: v.size_display(c, F.lit(D("1350.0"))), "1350-1500", "1350", None) == ["1350-1500", "1350", "1350"]


def test_nested_values(spark):
    cases = {'{"a": [1, {"b": "x  y"}], "c": null, "d": ""}': ["1", "x y"], "[]": [], "no": [], '{"a": "q\\"w", "b": true}': ['q"w', "true"], '"plain"': ["plain"], None: []}
    assert one(spark, v.flat_values, *cases) == list(cases.values())
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"}), (None, {"z": "1"}), ({"a": "1"}, None)], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in df.select(v.merged(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "b": None, "c": "3"}, {"z": "1"}, {"a": "1"}]


def test_changes():
    assert v.parse_changes(["grade=12Х18Н10Т", " dim1 = 2=3 ", "dim2=None", "dim2=null"]) == {"grade": "12Х18Н10Т", "dim1": "2=3", "dim2": None}
    for bad in (["grade"], ["=x"], ["a=1", "a=2"]):
        with pytest.raises(ValueError, match="field=value|two values"):
            v.parse_changes(bad)


def test_required_keys(spark):
    assert one(spark, v.required_profile, " лента  х ") == ["ЛЕНТА Х"] and one(spark, v.required_grade, "№ 12х-1") == ["NO12X1"]
    for f, bad in ((v.required_profile, " "), (v.required_grade, None)):
        with pytest.raises(Exception, match="is required"):
            one(spark, f, bad)


def test_compatible_signs(spark):
    import unicodedata

    signs = [chr(c) for c in range(0x80, 0xFFFF) if len(unicodedata.normalize("NFKC", chr(c))) == 1 and unicodedata.normalize("NFKC", chr(c)).isalnum() and ord(unicodedata.normalize("NFKC", chr(c))) < 0x530]
    got = one(spark, compatible, *signs)
    assert got == [unicodedata.normalize("NFKC", s) for s in signs]
    assert one(spark, grade_match_key, "１２Х１８Ｎ", "ﬁne², Ⅳ", "й", "№5", None) == ["12X18N", "FINE2IV", "Й", "NO5", None]
    assert one(spark, grade_match_key, "12Х18Н10Т «x»") == one(spark, compact_key, "12Х18Н10Т «x»")


def test_patterns_of_names(spark):
    df = spark.createDataFrame([("AISI-321", "труба aisi 321 x"), ("AISI-321", "aisi3215"), ("a.b", "xa b"), ("a.b", "(a_B)")], "name string, text string")
    assert [r[0] for r in df.select(F.expr("1").alias("_"), "*").select(F.call_function("rlike", "text", v.written_pattern(F.col("name")))).collect()] == [True, False, False, True]


def test_filters_and_pages(spark):
    df = spark.createDataFrame([(1, "OPEN"), (2, "DONE"), (3, "OPEN"), (4, None)], "id int, status string")
    assert listing.filtered(df, {"status": "all"}).count() == listing.filtered(df, {"status": " ", "id": None}).count() == 4
    total, part = listing.page(listing.filtered(df, {"status": "OPEN"}), [F.col("id").desc()], 1, 5)
    assert total == 2 and rows(part) == [(1, "OPEN")]
    with pytest.raises(ValueError, match="limit"):
        listing.page(df, [F.col("id")], 0, 0)
    rows_in = spark.createDataFrame([("b", 1, None), ("A", 2, None), ("a", 1, None), ("z", 9, "{}")], "source_file string, source_row int, source_columns string")
    assert [(r.source_file, r.source_row) for r in rows_in.orderBy(*listing.candidate_order()).collect()] == [("z", 9), ("a", 1), ("A", 2), ("b", 1)]
    names = spark.createDataFrame([(1, "one"), (1, "one"), (2, "two")], "id int, name string")
    assert rows(listing.with_lookups(df.select("id"), (names, "id", ["name"]))) == sorted([(1, "one"), (2, "two"), (3, None), (4, None)], key=repr)


def test_answers(spark):
    items = spark.createDataFrame([("s1", 1, "old"), ("s1", 2, "new"), (None, 3, "none")], "source string, n int, grade string")
    answers = spark.createDataFrame([("s1", "KEEP"), ("s9", "REVIEW"), (None, "KEEP")], "source_id string, decision string")
    got = listing.answers_to_items(answers, items, "source_id", "source", "n").select("source_id", "item_grade", "status")
    assert rows(got) == sorted([("s1", "new", None), ("s9", None, "SOURCE_ITEM_NOT_FOUND"), (None, None, "SOURCE_ITEM_NOT_FOUND")], key=repr)


def test_rows_to_show(spark):
    items = spark.createDataFrame([(1, "Пруток", "c"), (2, "КРУГ", None), (3, "ТРУБА", None), (4, None, None)], "id int, profile string, comment_text string")
    got = listing.rows_to_show(items, ("ПРУТОК", "КРУГ")).orderBy("id", "label").collect()
    note = "Поисковый синоним профиля: {}; исходный профиль поставщика: {}; не отдельная складская позиция"
    assert [(r.id, r.shown_profile, r.comment_text) for r in got] == [(1, "ПРУТОК", "c"), (1, "КРУГ", "c; " + note.format("КРУГ", "Пруток")), (2, "ПРУТОК", note.format("ПРУТОК", "КРУГ")), (2, "КРУГ", None)]
    assert [r.id for r in listing.rows_to_show(items, ("ТРУБА",)).collect()] == [3] and listing.rows_to_show(items, ()).count() == 4


def test_cases(spark):
    schema = "case_id string, case_type string, source_id string, supplier string, description string, current_profile string, current_grade string, current_dimensions array<string>, domain string"
    cases = spark.createDataFrame([("1", "control", "a", "s", "d", "p", "g", ["1", None, None], "m"), ("2", "candidate", "a", " ", "d", "p", "g", ["1"], "m"), ("2", "odd", "b", "s", "d", "p", "g", None, None), ("4", "control", "c", "s", "d", "p", "g", ["1", "2", "3"], "m")], schema)
    gold = spark.createDataFrame([("1",), ("1",), ("2",), ("7",)], "case_id string")
    want = [("1", "repeated_gold"), ("1", "repeated_source"), ("2", "case_type"), ("2", "dimensions"), ("2", "gold_of_no_control"), ("2", "missing_current_dimensions"), ("2", "missing_domain"), ("2", "missing_supplier"), ("2", "repeated_case"), ("4", "control_without_gold"), ("7", "gold_of_unknown_case")]
    assert rows(listing.case_problems(cases, gold)) == want
    assert listing.case_problems(cases.where("case_id = '1'"), gold.limit(1)).count() == 0
