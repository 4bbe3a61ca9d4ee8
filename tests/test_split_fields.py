import random

import pyarrow as pa
import pytest

from sortament.operators.split_fields import CHUNK, split_field, split_texts
from tests.conftest import rows

CASES = {
    "Труба A 1; Лист B 2": ["Труба A 1", "Лист B 2"],
    '"Плита 72 1x960; Шина в подарок"; Шины s=2,2': ["Плита 72 1x960; Шина в подарок", "Шины s=2,2"],
    'Круг 1/2" L=5 / "Лента ""А"" 2, Полоса отдельно" // //Круг X +': ['Круг 1/2" L=5', 'Лента "А" 2, Полоса отдельно', "Круг X"],
    ' "лист a" ;"Круг 3/4"" x"': ["лист a", 'Круг 3/4" x'],
    "Круг a\tтруба б \nЛента\n\n": ["Круг a", "труба б", "Лента"],
    "ТPУБА x • KPУГ y": ["ТPУБА x", "KPУГ y"],
    "г/к; Труба; x": [],
    "лента, СТП 1, г/к": [],
    '"Труба a / Втулка и Лента в комплекте"': [],
    "": [],
    '"Круг a; Круг b': ['"Круг a', "Круг b"],
    'Лист x "Б"; Круг "8 м" / Лист 2': ['Лист x "Б"', 'Круг "8 м"', "Лист 2"],
}


def split_all(texts):
    parents, positions, values = (a.to_pylist() for a in split_texts(pa.array(texts, pa.string())))
    out = [[] for _ in texts]
    for parent, position, value in zip(parents, positions, values, strict=True):
        out[parent].append(value)
        assert position == len(out[parent])
    return out


def test_cases():
    assert split_all(list(CASES)) == list(CASES.values())


def test_every_known_profile_begins_a_position():
    assert split_all(["Болт М10; Винт М8; Гайка М6", "Винт М8; Шайба 6", "Лом меди | Слиток 5 | Тройник 57", "Балка 20, Рулон 3"]) == [
        ["Болт М10", "Винт М8", "Гайка М6"], ["Винт М8", "Шайба 6"], ["Лом меди", "Слиток 5", "Тройник 57"], ["Балка 20", "Рулон 3"],
    ]


def test_rows_do_not_depend_on_neighbours():
    random.seed(1)
    for _ in range(30):
        texts = random.choices([*CASES, None, '"', '" "', ";;", "Труба"], k=random.randint(1, 12))
        assert split_all(texts) == [split_all([t])[0] for t in texts]


def test_sliced_and_null_batches():
    whole = pa.array(["Труба 1; Лист 2", None, "Круг 3 / Шина 4", "x"])
    parents, _, values = split_texts(whole.slice(1, 2))
    assert (parents.to_pylist(), values.to_pylist()) == ([1, 1], ["Круг 3", "Шина 4"])
    assert len(split_texts(pa.array([None, None], pa.string()))[0]) == 0


def test_operator(spark):
    long_text = "Труба " + "а" * (CHUNK + 10) + "; Лист 2"
    data = [(1, "Труба 1; Лист 2", "c"), (1, "Труба 1; Лист 2", "c"), (2, None, "c"), (3, "Круг", "c"), (None, "Круг 1|Шина 2", "c"), (5, long_text, "c")]
    df = spark.createDataFrame(data, "row_id long, t string, pos string")
    got = [(r[0], r[1], len(r[2])) for r in split_field(df, ["row_id"], "t").collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, 7), (1, 2, 6)] * 2 + [(None, 1, 6), (None, 2, 6), (5, 1, len(long_text) - 8), (5, 2, 6)], key=repr)
    assert split_field(df.where("false"), ["row_id"], "t").count() == 0


def test_string_keys(spark):
    df = spark.createDataFrame([("a", "x", "Труба 1; Лист 2")], "k string, l string, t string")
    assert rows(split_field(df, ["k", "l"], "t")) == [("a", "x", 1, "Труба 1"), ("a", "x", 2, "Лист 2")]


@pytest.mark.parametrize("query", ["p4_found"])
def test_query(spark, folder, query):
    from sortament.plans.registry import queries

    found = queries()[query](spark, folder)
    assert found.columns == ["src", "row_id", "pos", "item_text"] and found.count() > 0
    assert dict(found.dtypes) == {"src": "string", "row_id": "bigint", "pos": "bigint", "item_text": "string"}
