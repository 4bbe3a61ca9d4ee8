from decimal import Decimal

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sortament.operators.cells import carry_mappings, detect_headers, extract_rows, fill_down, stack_blocks
from sortament.operators.parse_items import parse_items
from sortament.sources.eml import parse_message, read_messages
from sortament.sources.jsonl import read_jsonl, write_jsonl
from sortament.sources.xlsx import column_name, free_name, price_files, read_cells, safe_sheet_name, write_workbook
from tests.conftest import rows

CELLS = "file string, sheet string, sheet_ix int, row_no int, cells array<struct<v:string,is_num:boolean>>"


def grid(spark, sheets):
    data = []
    for ix, (name, lines) in enumerate(sheets.items()):
        for n, line in enumerate(lines, 1):
            data.append(("new_supplier.xlsx", name, ix, n, [(v, False) for v in line]))
    return spark.createDataFrame(data, CELLS)


def test_header_and_rows(spark):
    cells = grid(
        spark,
        {
            "one": [["Прайс"], ["Наименование", "Марка", "Остаток", "Цена"], ["Труба 12Х18Н10Т 5х1,5", "12Х18Н10Т", "20 кг", "2090"], ["", None, "5 кг", "1"], ["Итого", "", "", "9"], [None, None, None, None]],
            "two": [["Лист 3", "", "1 т", "7"]],
        },
    )
    assert detect_headers(cells).select("sheet", "row_no").collect()[0] == ("one", 2)
    got = rows(extract_rows(cells).select("supplier", "description", "availability", "price", "sheet", "row_no"))
    assert got == [
        ("new supplier", "Лист 3", "1 т", "7", "two", 1), ("new supplier", "Труба 12Х18Н10Т 5х1,5", "20 кг", "2090", "one", 3), ("new supplier", "Труба 12Х18Н10Т 5х1,5", "5 кг", "1", "one", 4),
    ]


def test_vat_choice_and_late_header(spark):
    late = grid(spark, {"s": [[""]] * 50 + [["Наименование", "Цена без НДС", "Цена с НДС", "Остаток"], ["Пруток БрБ2 ф20", "1000", "1200", "5 кг"]]})
    row = extract_rows(late).first()
    assert (row.price, row.row_no) == ("1200", 52)
    assert extract_rows(grid(spark, {"s": [["a", "b"], ["c"]]})).count() == 0


def test_prices_say_what_they_include(spark):
    heads = ["Наименование", "Стоимость, включая НДС", "Цена руб./кг", "Цена без НДС"]
    grids = {"s": [heads, ["Лист 1", "10", "9", "8"], ["Лист 2", "10", "", ""], ["Лист 3", "", "9", "8"], ["Лист 4", "", "", "8"], ["Лист 5", "", "", ""]]}
    got = {r.description: (r.price, r.comments) for r in extract_rows(grid(spark, grids)).collect()}
    assert got == {
        "Лист 1": ("10", ["Из двух цен выбрана цена с НДС"]), "Лист 2": ("10", ["Цена указана с НДС"]), "Лист 3": ("9", ["Статус НДС в заголовке цены не определён"]),
        "Лист 4": ("8", ["Доступна только цена без НДС"]), "Лист 5": (None, []),
    }


def test_profile_and_size_columns(spark):
    grids = {"Склад": [["Наименование", "Вид проката", "Диаметр", "Размеры мм.", "Остаток\n в кг"], ["ЭИ868(ХН60ВТ)", "круг", "ф105", "360мм", "28.9"], ["ЭИ100(20Х13Н4Г9)", "лист", "", "0,8х980х1350-1500", "745.5"]]}
    got = [(r.description, r.profile_hint, r.size_primary, r.size_secondary, r.availability_unit) for r in extract_rows(grid(spark, grids)).orderBy("row_no").collect()]
    assert got == [("круг ЭИ868(ХН60ВТ) ф105 360мм", "круг", "ф105", "360мм", "кг"), ("лист ЭИ100(20Х13Н4Г9) 0,8х980х1350-1500", "лист", None, "0,8х980х1350-1500", "кг")]
    assert "Исходное обозначение поставщика: ЭИ868" in extract_rows(grid(spark, grids)).orderBy("row_no").first().comments


def test_late_header_and_shifted_columns(spark):
    heads = ["марки названия", "вид проката", "размер диамер / толшина", "длина / раскрой", "опысания / характеристика", "примичание", "в наличии"]
    body = [
        ["42ХНМ ЭП630У", "Круг", "ф5,6мм", "2000-2400мм", "ТУ", "", "в наличии"], ["ЭИ481Ш (37Х12Н8Г8МФБ-Ш", "ф20-90мм", "от 1000 кг", "ТУ 14-1-1923-76", "под заказ 70-90 дней", "", ""],
        ["Срок поставки 40 дней", "", "", "", "", "", ""], ["Круги ЭП33", "ф7", "ф8", "100", "x", "", "да"],
    ]
    cells = grid(spark, {"Под заказ": [[""]] * 50 + [heads, *body]})
    assert detect_headers(cells).first().mapping == {"description": 0, "profile": 1, "dim_primary": 2, "dimensions": 3, "availability": 6}
    got = [(r.profile_hint, r.size_primary, r.size_secondary, r.availability, r.row_no) for r in extract_rows(cells).orderBy("row_no").collect()]
    assert got == [("Круг", "ф5,6мм", "2000-2400мм", "в наличии", 52), (None, "ф20-90мм", None, "под заказ 70-90 дней", 53), ("КРУГ", "ф7", "100", "да", 55)]
    notes = extract_rows(cells).where("row_no = 53").first().comments
    assert "Обнаружено смещение колонок; значение «от 1000 кг» сохранено как дополнительное условие" not in notes  # "от 1000" reads as a size


def test_rows_above_a_later_header(spark):
    grids = {"a": [["Наименование", "Остаток", "Цена"], ["Лист 1", "2 т", "5"]], "b": [["Труба 2", "3 т", "6"], ["Цена", "Товар", "Наличие"], ["7", "Круг 3", "4 т"]], "c": [["8", "Лента 4", "5 т"]], "d": []}
    got = [(r.sheet, r.description, r.availability, r.price) for r in extract_rows(grid(spark, grids)).orderBy("sheet", "row_no").collect()]
    assert got == [("a", "Лист 1", "2 т", "5"), ("b", "Труба 2", "3 т", "6"), ("b", "Круг 3", "4 т", "7"), ("c", "Лента 4", "5 т", "8")]
    assert detect_headers(grid(spark, {"x": [["Наличие", "Наличие", "Наименование", "Наименование товара"]]})).first().mapping == {"availability": 0, "description": 2}


def test_carry_and_fill(spark):
    sheets = spark.createDataFrame([("f", "a", 0), ("f", "b", 1), ("f", "c", 2)], "file string, sheet string, sheet_ix int")
    headers = spark.createDataFrame([("f", "b", 1, 3, {"description": 0})], "file string, sheet string, sheet_ix int, row_no int, mapping map<string,int>")
    got = [(r.sheet, r.own, r.before, r.header_row) for r in sorted(carry_mappings(sheets, headers).collect())]
    assert got == [("a", None, None, None), ("b", {"description": 0}, None, 3), ("c", None, {"description": 0}, None)]
    df = spark.createDataFrame([("g", 1, "x"), ("g", 2, " "), ("g", 3, None), ("h", 1, "")], "g string, n int, v string")
    assert rows(fill_down(df, "v", ["g"], "n")) == sorted([("g", 1, "x"), ("g", 2, "x"), ("g", 3, "x"), ("h", 1, None)], key=repr)


def test_stack(spark):
    df = spark.createDataFrame([(1, "a", 2, "b")], "n1 int, t1 string, n2 int, t2 string")
    assert rows(stack_blocks(df, [["n1", "t1"], ["n2", "t2"]], ["n", "t"])) == [(0, 1, "a"), (1, 2, "b")]


def test_folder_of_price_lists(spark, tmp_path):
    for name in ("b.xlsx", "A b+c.XLSX", "old.xls", "~$b.xlsx", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [(r.file, r.readable) for r in price_files(spark, str(tmp_path)).collect()] == [("A b+c.XLSX", True), ("b.xlsx", True), ("old.xls", False)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        price_files(spark, str(tmp_path / "none"))


def test_workbook_round_trip(spark, tmp_path):
    write_workbook(str(tmp_path / "p.xlsx"), {"Лист/1": [["Наименование", "Цена"], ["Труба <5>", Decimal("20.5")], [None, 7]], "b": []})
    (tmp_path / "~$p.xlsx").write_bytes(b"lock")
    got = sorted(read_cells(spark, str(tmp_path)).collect(), key=lambda r: (r.sheet_ix, r.row_no))
    assert [(r.file, r.sheet, r.row_no, [tuple(c) for c in r.cells]) for r in got] == [
        ("p.xlsx", "Лист_1", 1, [("Наименование", False), ("Цена", False)]), ("p.xlsx", "Лист_1", 2, [("Труба <5>", False), ("20.5", True)]), ("p.xlsx", "Лист_1", 3, [(None, False), ("7", True)]),
    ]
    assert (column_name(0), column_name(25), column_name(26), column_name(701), column_name(702)) == ("A", "Z", "AA", "ZZ", "AAA")
    assert safe_sheet_name("a" * 40 + "[]") == "a" * 31 and free_name({"r.xlsx", "r2.xlsx"}, "r", ".xlsx") == "r3.xlsx"


def test_jsonl(spark, tmp_path):
    schema = StructType([StructField("id", StringType()), StructField("n", LongType())])
    (tmp_path / "a.jsonl").write_text('﻿{"id": "a", "n": 1}\n\n# note\n{"id": "b"}\n{"n": 2}\n[1]\n{"id": "c", "x": 1}\nno\n', encoding="utf-8")
    good, bad = read_jsonl(spark, str(tmp_path / "a.jsonl"), schema, required=("id",))
    assert rows(good) == [("a", 1), ("b", None)]
    assert sorted(r.reason for r in bad.collect()) == ["missing_field", "not_an_object", "not_an_object", "unknown_field"]
    write_jsonl(good, str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out"))) == [('{"id":"a","n":1}',), ('{"id":"b","n":null}',)]


MESSAGE = (
    b"From: a@x\r\nTo: b@x\r\nSubject: =?utf-8?b?0KbQtdC90LA=?=\r\nMessage-ID: <M1@x>\r\nDate: Mon, 06 Jan 2025 10:00:00 +0300\r\nMIME-Version: 1.0\r\n"
    b'Content-Type: multipart/mixed; boundary="q"\r\n\r\n--q\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n\xd0\xa6\xd0\xb5\xd0\xbd\xd0\xb0\r\n'
    b'--q\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename="p.exe"\r\n\r\nMZ\r\n--q--\r\n'
)


def test_messages(spark, tmp_path):
    m = parse_message(MESSAGE)
    assert (m["message_key"], m["subject"], m["body_text"].strip(), m["attachments"][0]["name"], str(m["sent_at"])) == ("m1@x", "Цена", "Цена", "p.exe", "2025-01-06 07:00:00")
    (tmp_path / "a.eml").write_bytes(MESSAGE)
    (tmp_path / "b.eml").write_bytes(MESSAGE)
    (tmp_path / "c.eml").write_bytes(b"no header")
    assert read_messages(spark, str(tmp_path)).count() == 2


def test_parse_items(spark):
    data = [
        (1, " ООО  Р ", "Труба 12Х18Н10Т 5х1,5х2000", "20 кг", "2'090.00 руб.", None, None), (2, "s", "Лист 08Х18Н10 3x1000x2000", "5", None, "12Х18Н10Т", '{"availability_unit": "т"}'),
        (3, "s", None, None, None, None, None), (4, "s", "Лом Б26", None, "x", "Б26", None),
    ]
    items = spark.createDataFrame(data, "item_id long, supplier string, description string, availability string, price string, grade_hint string, extra_json string")
    got = {r.item_id: r for r in parse_items(items).collect()}
    assert (got[1].supplier, got[1].profile, got[1].grade_key, float(got[1].dim2), float(got[1].price_rub_kg), got[1].confidence) == ("ООО Р", "ТРУБА", "12X18H10T", 1.5, 2090.0, 1.0)
    assert got[2].review_reasons == ["grade_conflict"] and (float(got[2].quantity_value), got[2].quantity_unit) == (5.0, "т")
    assert got[3].review_reasons == ["profile_unparsed", "unconfirmed_grade", "dimension_unparsed"]
    assert got[4].domain == "FERROUS_SCRAP" and got[4].review_reasons == []
