from decimal import Decimal as D

import random

import pytest
from pyspark.sql import functions as F

from sortament.llm import product_groups as pg
from sortament.llm.product_groups import containments, distinct_sets, product_groups, product_pairs, product_tokens, star_clusters
from tests.conftest import rows

OFFERS = "offer_id long, raw_description string, profile string, grade string, dim1 decimal(18,6), dim2 decimal(18,6), dim3 decimal(18,6), dim1_unit string, tokens string, whole string"
GRADES = [("gr-1", "72ХН5П28Г"), ("gr-2", "ЛД572-2АЕ")]
ALIASES = [("al-1", "LIGIZ 912K", "gr-2")]
DATA = [
    (1, "Лента ЛД572-2AE 1,45 х 270 5400мм лучшая цена", "ЛЕНТА", None, None, None, None, None),
    (2, "5400 мм; LIGIZ  912K; г/к", "ЛЕНТА", "72ХН5П28Г", D("0.145"), D(270), D(5400), "см"),
    (3, "ленты s=1.45 раскрой 270x5400", None, "лд57-2-ае", None, None, None, None),
    (4, "лента лд572-2ае 0,145x27x540 см; СТП 1-2", "НЕ УКАЗАН", "предпол.", D(9), None, None, "MM"),
    (5, "лента лд572-2ае 1,45x270x5410", None, None, None, None, None, None),
    (6, "Лист 1; лента лд572-2ае 1,45x270x5400", None, None, None, None, None, None),
    (7, None, "ЛЕНТА", "ЛД572-2АЕ", D("1.45"), D(270), D(5400), "MM"),
    (8, "лента 93Г12Д7УГ 1,45x270x5400", None, None, None, None, None, None),
    (9, "1,45x270x5400 лента 93г12д7уг " + "слово " * 20_000, None, None, None, None, None, None),
    (10, "", None, None, None, None, None, None),
    (11, None, None, None, None, None, None, None),
    (None, "лента лд572-2ае 1,45x270x5400", None, None, None, None, None, None),
    (12, 'Круг 3/4" L=6 м 72XH5П28Г', None, None, None, None, None, None),
    (13, "ф19,05x6000", "КРУГ", "ст. 72ХН5П2Г", None, None, None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame([(*r, "x", "y") for r in DATA], OFFERS),
        spark.createDataFrame(GRADES, "grade_id string, canonical string"),
        spark.createDataFrame(ALIASES, "alias_id string, alias string, canonical_grade_id string"),
    )


WANT = [{1, 2, 3, 4, 7}, {8, 9}, {12, 13}]


def test_pairs(spark, tables):
    want = sorted(((a, b) for g in WANT for a in g for b in g if a < b), key=repr)
    assert rows(product_pairs(*tables)) == want
    twice = tables[0].unionByName(tables[0])
    assert rows(product_pairs(twice, *tables[1:])) == want
    assert product_pairs(tables[0].where("false"), *tables[1:]).count() == 0


def test_groups(spark, tables):
    got = {r.offer_id: (r.group_id, r.links) for r in product_groups(*tables).collect()}
    for g in WANT:
        for i in g:
            assert got[i] == (min(g), len(g) - 1)
    assert {i: got[i] for i in (5, 6, 10, 11)} == {i: (i, 0) for i in (5, 6, 10, 11)}
    assert len(got) == len(DATA) - 1


def test_incomplete_offers_join_the_star_that_contains_them(spark, tables):
    more = spark.createDataFrame([(20, "лента 1,45x270x5410", None, None, None, None, None, None, "x", "y")], OFFERS)
    offers = tables[0].where("offer_id = 5").unionByName(more)
    assert not product_tokens(offers, *tables[1:]).where("id = 20").first().complete
    assert rows(product_pairs(offers, *tables[1:])) == [(5, 20)]


def test_empty_lists(spark, tables):
    none = tables[1].where("false"), tables[2].where("false")
    assert (8, 9) in rows(product_pairs(tables[0], *none))


def test_every_token_counts(spark, tables):
    four = [(30, "Уголок 93Г12Д7УГ 50х50х5 L=6000"), (31, "уголок 93г12д7уг L=6000 50x50x5"), (32, "Уголок 93Г12Д7УГ 50х50х5 L=12000"), (33, "Уголок 93Г12Д7УГ 50х50х5")]
    five = [(40, "Лента 93Г12Д7УГ 50х50х5 40х20 L=6000"), (41, "лента 93Г12Д7УГ 50х50х5 40х20 L=6 м"), (42, "Лента 93Г12Д7УГ 50х50х5 40х30 L=6000")]
    offers = spark.createDataFrame([(*r, *[None] * 6, "x", "y") for r in four + five], OFFERS)
    assert rows(product_pairs(offers, *tables[1:])) == [(30, 31), (40, 41)]
    assert {r.offer_id: r.group_id for r in product_groups(offers, *tables[1:]).collect()} == {30: 30, 31: 30, 32: 32, 33: 33, 40: 40, 41: 40, 42: 42}


def test_identical_offers_are_pairs(spark, tables):
    texts = [(60, "Проволока Ст3 3 мм"), (61, "Проволока Ст3 3 мм"), (62, "фланец Ст3 50x40"), (63, "фланец Ст3 50x40"), (64, "проволока"), (65, "проволока"), (66, "Ст3"), (67, "Ст3")]
    offers = spark.createDataFrame([(*r, *[None] * 6, "x", "y") for r in texts], OFFERS)
    assert rows(product_pairs(offers, *tables[1:])) == [(60, 61), (62, 63)]
    assert product_groups(offers, *tables[1:]).count() == len(texts)


def test_large_stars_are_paired_in_blocks(spark, tables, monkeypatch):
    monkeypatch.setattr(pg, "BLOCK", 4)
    offers = spark.createDataFrame([(i, "Круг 93Г12Д7УГ ф20", *[None] * 6, "x", "y") for i in range(30)], OFFERS)
    assert rows(product_pairs(offers, *tables[1:])) == sorted(((a, b) for a in range(30) for b in range(a + 1, 30)), key=repr)


def test_large_sets_that_many_offers_share(spark):
    def sets(n, letters, start=0):
        return spark.range(start, start + n).select("id", F.array(*[F.lit(t) for t in letters]).alias("tokens"), F.lit(True).alias("complete"))

    got = distinct_sets(sets(12_000, "abcdef").unionByName(sets(3, "hgabcde", 20_000))).select(F.array_join("tokens", "").alias("t"), "first", "members")
    assert rows(got) == [("fabcde", 0, 12_000), ("ghabcde", 20_000, 3)]


@pytest.mark.parametrize(("containment", "cover"), [(1.0, 0.5), (0.8, 0.4), (0.5, 0.0)])
def test_containments_like_brute_force(spark, containment, cover):
    pick = random.Random(containment)
    data = [(i, sorted({f"t{min(int(pick.expovariate(0.2)), 14)}" for _ in range(pick.randint(1, 8))}), pick.random() < 0.5) for i in range(150)]
    sets = distinct_sets(spark.createDataFrame(data, "id long, tokens array<string>, complete boolean")).collect()
    df = spark.createDataFrame(sets)
    weights = [{**dict(zip(r.tokens, r.weights, strict=True))} for r in sets]
    want = []
    for a, wa in zip(sets, weights, strict=True):
        for b, wb in zip(sets, weights, strict=True):
            if not a.complete and b.complete:
                shared = sum(wa[t] for t in wa.keys() & wb.keys())
                if shared >= containment * sum(wa.values()) - 1e-5 and shared >= cover * sum(wb.values()) - 1e-5 and shared > 0:
                    want.append((a.node, b.node))
    got = containments(df.where("not complete"), df.where("complete"), containment, cover).select("node", "centre")
    assert len(want) > 5 and rows(got) == sorted(want, key=repr)


def test_stars(spark):
    data = [(1, ["p=a", "g=x", "1=5"], True), (2, ["p=a", "g=y", "1=5"], True), (3, ["g=x", "1=5"], False), (4, ["p=a", "1=7"], False), (5, ["g=z", "1=9"], False), (6, [], False)]
    sets = distinct_sets(spark.createDataFrame(data, "id long, tokens array<string>, complete boolean"))
    names = {r.number: r.node.replace("\n", " ") for r in sets.collect()}
    got = star_clusters(sets).collect()
    plain = {r.node.replace("\n", " "): (names[r.star], r.told) for r in got}
    assert {names[r.star]: r.n for r in got}["1=5 g=x p=a"] == 2
    assert plain["1=5 g=x"] == ("1=5 g=x p=a", True)  # of the two that have 1=5 the one that has g=x
    assert plain["1=7 p=a"] == ("1=7 p=a", False) and plain["1=9 g=z"] == ("1=9 g=z", False)
    assert plain["1=5 g=y p=a"] == ("1=5 g=y p=a", True) and len(plain) == 5


def test_products_of_one_size(spark, tables):
    texts = [(50, "Круг 93Г12Д7УГ ф20"), (51, "круг 93г12д7уг 20 мм"), (52, "Круг 93Г12Д7УГ ф20 L=6000"), (53, "круг 93г12д7уг 6 м ф20"), (54, "круг 93Г12Д7УГ ф25"), (55, "ф20 L=6000 93г12д7уг")]
    alone = [(56, "93Г12Д8УГ ф20 L=6000"), (57, "93Г12Д8УГ L=6 м ф20")]  # of unknown profiles
    offers = [(*r, *[None] * 6, "x", "y") for r in texts + alone]
    offers.append((58, "круг 93г12д7уг 20 мм", None, None, D(25), None, None, "MM", "x", "y"))  # the text wins
    got = rows(product_pairs(spark.createDataFrame(offers, OFFERS), *tables[1:]))
    assert got == [(50, 51), (50, 58), (51, 58), (52, 53), (52, 55), (53, 55)]
