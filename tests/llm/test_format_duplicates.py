import random
from collections import defaultdict
from decimal import Decimal

from sortament.llm.format_duplicates import collapse, duplicate_sets, offer_duplicates
from tests.conftest import rows

SCHEMA = "offer_id long, raw_description string, supplier string, price_rub_kg decimal(18,4)"


def test_cases(spark):
    d = Decimal
    data = [
        (1, "Труба 5,5 x г/к", 'ООО "Р"', d(1)), (2, "г К/ труба  5.5 X", "р, ооо", d(1)), (3, "Труба 55 x г/к", 'ООО "Р"', d(1)), (4, "Труба 5,5 x г/к", 'ООО "Р"', None),
        (5, "Труба 5,5 x г/к", 'ООО "Р"', None), (6, "Труба 5,5 x г/к г", 'ООО "Р"', d(1)), (7, None, None, d(2)), (8, "", " ", d(2)), (9, "Труба 5,5 x г/к", 'ООО "Р"', d("1.0001")),
        (None, "x", "y", d(3)), (None, "x", "y", d(3)),
    ]
    assert rows(offer_duplicates(spark.createDataFrame(data, SCHEMA))) == [(1, 1, 2), (2, 1, 2), (7, 7, 2), (8, 7, 2)]
    assert offer_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_set_over_many_partitions(spark):
    random.seed(5)
    forms = ["Труба А 5.5"] * 5 + ["Лист Б"] * 2
    data = [(i, random.choice(forms) if i % 3 else f"y {random.randrange(900)}", "s", Decimal(1)) for i in range(6000)]
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[t].append(i)
    want = sorted((i, min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g)
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(tuple(r) for r in offer_duplicates(df).collect()) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_texts(spark):
    long_text = "слово " * 100_000
    data = [(1, long_text, "s", Decimal(1)), (2, long_text.upper(), "s", Decimal(1)), (3, long_text + "x", "s", Decimal(1))]
    assert rows(offer_duplicates(spark.createDataFrame(data, SCHEMA))) == [(1, 1, 2), (2, 1, 2)]


def test_collapse_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "p"), (2, "B A", "q"), (3, "c", "r")], "id long, t string, first string")
    assert rows(collapse(df, "id", exact=[], texts=["t"]).select("id", "first", "copies")) == [(1, "p", 2), (3, "r", 1)]
    assert rows(duplicate_sets(df, "id", exact=["first"], texts=["t"])) == []


def test_same_id_twice(spark):
    df = spark.createDataFrame([(1, "a", "s", Decimal(1)), (1, "A", "s", Decimal(1)), (1, "b", "s", Decimal(1)), (1, "B", "s", Decimal(1))], SCHEMA)
    assert rows(offer_duplicates(df)) == [(1, 1, 2)] * 4
