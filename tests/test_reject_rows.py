import re
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sortament.operators.reject_rows import load_lines, reject_counts
from tests.conftest import rows

GOOD = 'ООО Р;"Труба; 5x1";5 кг;1 209,01;;2025-05-28'
CASES = {
    GOOD: None,
    'а;"б ""в"" ю";;;;': None,
    '"a";"я\nю";;"3\'412,17 руб.";"";31.12.2024': None,
    "a;Труба 3/4\" рез.;1;2;;": "broken_quoting",
    'a;"Труба;1;2;;': "broken_quoting",
    'a;"Труба"x;1;2;;': "broken_quoting",
    'a; "Труба";1;2;;': "broken_quoting",
    "a;я\nю;1;2;;": "broken_quoting",
    "a;Труба;1;2;": "column_count",
    "a;Труба;1;2;;;": "column_count",
    "": "column_count",
    "a;123;1;2;;": "invalid_value",
    "a;Тру�ба;1;2;;": "invalid_value",
    "a;Труба;1;по запросу;;": "invalid_value",
    "a;Труба;1;0;;": "invalid_value",
    "a;Труба;1;-5;;": "invalid_value",
    "a;Труба;1;10000000;;": "invalid_value",
    "a;Труба;1;9999999,9999;;": None,
    "a;Труба;1;1,23456;;": "invalid_value",
    "a;Труба;1;1.2.3;;": "invalid_value",
    "a;Труба;1;2 500 ₽;;": None,
    "a;Труба;1;  ;;  ": None,
    "a;Труба;1;5;;31.02.2024": "invalid_value",
    "a;Труба;1;5;;29.02.2024": None,
    "a;Труба;1;5;;2023-02-29": "invalid_value",
    "a;Труба;1;5;;01/02/2024": "invalid_value",
    "a;Труба;1;5;;0000-01-01": "invalid_value",
}


def test_reasons(spark):
    lines = list(CASES)
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")
    got = {r.line_id: r.reason for r in load_lines(df, "line_id", "raw_line").rejected.collect()}
    assert {lines[i]: got.get(i) for i in range(len(lines))} == CASES


def test_loaded_values(spark):
    df = spark.createDataFrame([(1, GOOD)], "line_id long, raw_line string")
    row = load_lines(df, "line_id", "raw_line").loaded.first()
    assert (row.description, float(row.price), row.price_date) == ("Труба; 5x1", 1209.01, date(2025, 5, 28))


def test_nulls_empty_long_and_repeated(spark):
    long_line = "a;" + '"' + "я""; " * 50_000 + '"' + ";1;2;;"
    df = spark.createDataFrame([(1, None), (2, "a;" + "я" * 300_000 + ";1;2;;"), (3, long_line), (4, "x"), (4, "x"), (None, "x")], "line_id long, raw_line string")
    got = rows(load_lines(df, "line_id", "raw_line").rejected)
    assert got == sorted([(1, "column_count"), (4, "column_count"), (None, "column_count")], key=repr)
    none = load_lines(df.where("false"), "line_id", "raw_line")
    assert none.rejected.count() == none.loaded.count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", "y", "z")], "line_id long, raw_line string, key string, rank string")
    assert rows(load_lines(df, "line_id", "raw_line").rejected) == [(1, "column_count")]


def test_counts(spark):
    df = spark.createDataFrame([(1, "f", GOOD), (2, "f", "x"), (3, "g", GOOD)], "line_id long, source_file string, raw_line string")
    got = reject_counts(df, load_lines(df, "line_id", "raw_line").rejected, "line_id", "source_file")
    assert {r.source_file: (r.lines, r.loaded, r.skipped_rows) for r in got.collect()} == {"f": (2, 1, 1), "g": (1, 1, 0)}


FIELD = r'(?:"(?:[^"]|"")*"|[^";\r\n]*)'


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet='a";\n я', max_size=12), min_size=1, max_size=60))
def test_splitting_like_the_format(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")
    got = {r.line_id: r.reason for r in load_lines(df, "line_id", "raw_line").rejected.collect()}
    for i, line in enumerate(lines):
        ok = re.fullmatch(f"{FIELD}(?:;{FIELD})*", line) is not None
        assert (got.get(i) != "broken_quoting") == ok, line


def test_round_trip(spark):
    fields = ["a;b", 'я "в"', "c\nd", "1,5", "", "01.02.2024"]
    line = ";".join('"' + f.replace('"', '""') + '"' for f in fields)
    row = load_lines(spark.createDataFrame([(1, line)], "line_id long, raw_line string"), "line_id", "raw_line").loaded.first()
    assert (row.supplier, row.description, row.availability) == tuple(fields[:3])


@pytest.mark.parametrize("query", ["p3_found", "p3_loaded", "p3_parse_stats"])
def test_queries(spark, folder, query):
    from sortament.plans.registry import queries

    assert queries()[query](spark, folder).count() > 0
