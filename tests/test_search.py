import itertools
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from sortament.functions.distances import _similarity
from sortament.operators import catalog, search_catalog
from sortament.operators.resolve_profile import resolve_profiles
from sortament.operators.search_catalog import catalog_search, fuzzy_pairs, search_warnings
from sortament.operators.search_mask import EXACT, Inventory, expand_round_bars, inventory_of, mask_search, ranked, read_mask
from tests.conftest import rows

ITEMS = "offer_id long, supplier string, profile string, grade string, dim1 decimal(18,6), dim2 decimal(18,6), dim3 decimal(18,6), dim1_unit string, raw_description string, comment_text string"


@pytest.fixture(scope="module")
def items(spark):
    d = D
    data = [
        (1, "S", "ПРУТОК", "БРБ2", d(20), None, None, None, "Пруток БрБ2 ф20", None),
        (2, "S", "КРУГ", "БРБ2", d(22), None, None, None, "Круг БрБ2 ф22", None),
        (3, "S", "КВАДРАТ", "20", d(100), None, None, None, "Квадрат ст.20 100", None),
        (4, "S", "КВАДРАТ", "45", d(90), None, None, None, "Квадрат ст.45 90", None),
        (5, "S", "ТРУБА", "09Г2С", d(150), d(60), None, None, "Труба 09Г2С 150х60", None),
        (6, "S", "АНОД", "CU-DHP", d(25), None, None, None, "Анод Cu-DHP 25", None),
        (7, "S", "АНОД", "CU-DXP", d(10), d(100), d(1600), None, "Аноды плоские Cu-DXP", None),
        (8, "S", None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(data, ITEMS)


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("Квадрат 100", [3, 4]), ("Аноды плоские Cu-DXP 10 x 100 x 1600", [7]), ("150х60", [5, 7]), ("БрБ2 ф20", [1, 2]), ("Квадрат", [3, 4]), ("Cu-DHP", [6]),
        ("Стол 1000х1500", []), ("", []), ("Круг 20", [1, 2]),
    ],
)
def test_mask_search(items, query, found):
    mask = read_mask(query, inventory_of(items))
    assert [r.offer_id for r in ranked(mask_search(items, mask), "supplier", "offer_id").collect()] == found


def test_match_type_and_expansion(items):
    mask = read_mask("Пруток БрБ2 20", inventory_of(items))
    hits = mask_search(items, mask)
    assert {r.offer_id: (r.match_type == EXACT, float(r.size_delta)) for r in hits.collect()} == {1: (True, 0.0), 2: (False, 2.0)}
    assert rows(expand_round_bars(hits).select("offer_id", "display_profile", "is_profile_alias")) == [
        (1, "КРУГ", True), (1, "ПРУТОК", False), (2, "КРУГ", False), (2, "ПРУТОК", True),
    ]


def test_mask_reading():
    inventory = Inventory(frozenset({"ТРУБА"}), {"12X18H10T": "12Х18Н10Т", "20": "20"})
    mask = read_mask("труба 12х18н10т 57х3,5 ГОСТ 9941", inventory)
    assert (mask.grade_key, mask.sizes, mask.profiles) == ("12X18H10T", (D(57), D("3.5")), ("ТРУБА",))
    assert read_mask("труба ГОСТ 9941", inventory).sizes == ()
    assert read_mask("труба 5 кг 20", inventory).sizes == (D(20),)


def test_inventory_bound(items):
    with pytest.raises(ValueError, match="more than"):
        inventory_of(items, most=2)


GRADES = [("g1", "12Х18Н10Т"), ("g2", "БРБ2"), ("g3", "304L"), ("g4", "904L"), ("g5", "AISI321")]
ALIASES = [("a1", "C17200", "g2", "CONFIRMED"), ("a2", "OLD", "g1", "REJECTED")]
RELATIONS = [(1, "g1", "g5", "EQUIVALENT", "CONFIRMED", True), (2, "g3", "g1", "APPROXIMATE", "CONFIRMED", False), (3, "g3", "g4", "EQUIVALENT", "REJECTED", True)]


@pytest.fixture(scope="module")
def lists(spark):
    return (
        spark.createDataFrame([(*g, "PROPOSED", None) for g in GRADES], "grade_id string, canonical string, status string, source_reference string"),
        spark.createDataFrame(ALIASES, "alias_id string, alias string, canonical_grade_id string, status string"),
        spark.createDataFrame(RELATIONS, "equivalence_id long, source_grade_id string, target_grade_id string, relation_type string, status string, bidirectional boolean"),
    )


QUERY = "query_id string, profile string, grade string, q1 decimal(18,6), q2 decimal(18,6), q3 decimal(18,6), q_unit string"


def stock(spark, data):
    return spark.createDataFrame([(i, "S", p, g, *[D(x) if x is not None else None for x in s], u, None, None) for i, p, g, s, u in data], ITEMS)


def search(spark, query, data, lists, **options):
    asked = spark.createDataFrame([("q", query[0], query[1], *[D(x) if x is not None else None for x in query[2]], query[3] if len(query) > 3 else None)], QUERY)
    found = catalog_search(asked, stock(spark, data), *lists, **options).collect()
    return [(r.offer_id, r.match_type, r.requires_review, r.tie) for r in sorted(found, key=lambda r: r.position)]


def test_exact_suppresses_near(spark, lists):
    data = [(1, "ТРУБА", "12X18H10T", ("5", "2", None), None), (2, "ТРУБА", "12Х18Н10Т", ("5", "1.5", None), None)]
    assert search(spark, ("ТРУБА", "12Х18Н10Т", ("5", "1.5", None)), data, lists) == [(2, "EXACT", False, False)]
    assert search(spark, ("ТРУБА", "12Х18Н10Т", ("5", "1.5", None)), data[:1], lists) == [(1, "NEAR_DIMENSION", True, False)]


def test_alias_relation_and_fuzzy(spark, lists):
    data = [(1, "КРУГ", "БРБ2", ("20", None, None), None), (2, "КРУГ", "AISI321", ("20", None, None), None)]
    assert search(spark, ("ПРУТОК", "C17200", ("20", None, None)), data, lists) == [(1, "ALIAS", True, False)]
    assert search(spark, ("ПРУТОК", "C1720O", ("20", None, None)), data, lists, threshold=0.75) == [(1, "FUZZY", True, False)]
    assert search(spark, ("КРУГ", "12Х18Н10Т", ("20", None, None)), data, lists) == [(2, "CONFIRMED_RELATION", False, False)]
    assert search(spark, ("ЛИСТ", "БРБ2", (None, None, None)), data, lists) == []


def test_confirmed_aliases_need_no_review(spark, lists):
    grades, aliases, relations = lists
    sure = grades.withColumn("status", F.lit("CONFIRMED")), aliases, relations
    data = [(1, "КРУГ", "БРБ2", ("20", None, None), None)]
    assert search(spark, ("ПРУТОК", "C17200", ("20", None, None)), data, sure) == [(1, "ALIAS", False, False)]


def test_proposals_fuzzy_and_near_sizes_can_be_hidden(spark, lists):
    grades, aliases, relations = lists
    proposed = grades, aliases, relations.withColumn("status", F.lit("PROPOSED"))
    data = [(1, "КРУГ", "AISI321", ("20", None, None), None)]
    asked = ("КРУГ", "12Х18Н10Т", ("20", None, None))
    assert search(spark, asked, data, proposed) == [(1, "PROPOSED_RELATION", True, False)]
    assert search(spark, asked, data, proposed, include_proposed=False, threshold=0.0) == []  # no fuzzy fallback
    typo = ("КРУГ", "AISI32", ("20", None, None))
    assert search(spark, typo, data, lists) == [(1, "FUZZY", True, False)] and search(spark, typo, data, lists, include_fuzzy=False) == []
    near = ("КРУГ", "AISI321", ("21", None, None))
    assert search(spark, near, data, lists) == [(1, "NEAR_DIMENSION", True, False)] and search(spark, near, data, lists, include_unruled_near=False) == []


def test_rules_bound_near_sizes(spark, lists):
    schema = "rule_id string, profile string, tolerance1 decimal(18,6), tolerance2 decimal(18,6), tolerance3 decimal(18,6), status string, source_reference string"
    rules = spark.createDataFrame([("r2", "ТРУБА", D(9), D(9), D(9), "CONFIRMED", "s"), ("r1", "ТРУБА", D(0), D("0.5"), None, "CONFIRMED", "s"), ("r0", "ТРУБА", D(9), D(9), D(9), "PROPOSED", None)], schema)
    data = [(1, "ТРУБА", "304L", ("5", "2", None), None), (2, "ТРУБА", "304L", ("5", "2.1", None), None), (3, "ТРУБА", "304L", ("5.1", "1.5", None), None), (4, "ТРУБА", "304L", ("5", None, None), None)]
    asked = spark.createDataFrame([("q", "труба", "304L", D(5), D("1.5"), None, None), ("none", "ЛИСТ", "304L", None, None, None, None)], QUERY)
    found = catalog_search(asked, stock(spark, data), *lists, rules=rules, include_unruled_near=False)
    assert [(r.offer_id, r.match_type, r.rule_id, r.warnings, r.requires_review) for r in found.collect()] == [(1, "NEAR_DIMENSION", "r1", ["NEAR_SIZE_NEEDS_CONFIRMATION"], True)]
    assert rows(search_warnings(asked, found)) == [("none", ["NOTHING_FOUND"]), ("q", ["ALL_NEED_REVIEW"])]
    assert {r.check for r in catalog.catalog_violations(lists[0], lists[1], None, rules).collect()} == {"several_confirmed_rules"}
    bad = rules.withColumn("tolerance3", F.lit(-1).cast("decimal(18,6)")).withColumn("source_reference", F.lit(" "))
    assert {"negative_tolerance", "rule_without_source"} <= {r.check for r in catalog.catalog_violations(lists[0], lists[1], None, bad).collect()}


@pytest.mark.parametrize("threshold", [0.95, 0.82, 0.7, 0.5, 0.2, 0.1])
def test_fuzzy_pairs_like_brute_force(spark, threshold):
    pick = random.Random(threshold)
    keys = sorted({"".join(pick.choices("AB12X", k=pick.randint(1, 9))) for _ in range(70)})
    asked, spelled = keys[::2], keys[1::2] + keys[:6]
    got = fuzzy_pairs(spark.createDataFrame([(k, k) for k in asked], "query_grade string, qk string"), spark.createDataFrame([(k, k) for k in spelled], "item_grade string, spelling string"), threshold)
    assert {(r.query_grade, r.item_grade) for r in got.collect()} == {(a, b) for a in asked for b in spelled if _similarity(a, b) >= threshold}


def test_profiles_of_the_inventory(spark):
    items = spark.createDataFrame([("Пруток",), ("ТРУБА",), ("труба ",), ("ЛЕНТА",), ("Шестигранник",), (None,), (" ",)], "profile string")
    asked = ["ПРУТОК", "Прутокк", "круг", "ТРУАБ", "лЕнТа", "Мебель", "", "шестиграник", "шестиграни", "Ё"]
    got = {r["query"]: (r.status, r.profile, r.edits) for r in resolve_profiles(items, spark.createDataFrame([(a,) for a in [*asked, None]], "query string")).collect()}
    assert got == {
        "ПРУТОК": ("EXACT", "ПРУТОК", 0), "Прутокк": ("CORRECTED", "ПРУТОК", 1), "круг": ("EXACT", "КРУГ", 0), "ТРУАБ": ("CORRECTED", "ТРУБА", 1), "лЕнТа": ("EXACT", "ЛЕНТА", 0),
        "Мебель": ("NOT_FOUND", None, None), "": ("ALL", None, None), "шестиграник": ("CORRECTED", "ШЕСТИГРАННИК", 1), "шестиграни": ("CORRECTED", "ШЕСТИГРАННИК", 2), "Ё": ("NOT_FOUND", None, None),
    }
    tie = spark.createDataFrame([("ЛИСТ",), ("ЛИСА",)], "profile string")
    assert rows(resolve_profiles(tie, spark.createDataFrame([("ЛИС",)], "query string")).select("status")) == [("NOT_FOUND",)]
    assert resolve_profiles(items.where("false"), spark.createDataFrame([("x",)], "query string")).first().status == "NOT_FOUND"


def test_low_thresholds_reach_longer_spellings(spark, lists):
    data = [(1, "КРУГ", "304LABCDE", ("20", None, None), None)]
    assert search(spark, ("КРУГ", "304L", ("20", None, None)), data, lists, threshold=0.55) == [(1, "FUZZY", True, False)]
    assert search(spark, ("КРУГ", "304L", ("20", None, None)), data, lists) == search(spark, ("КРУГ", "-", ("20", None, None)), data, lists, threshold=0.0) == []


def test_tie_and_units(spark, lists):
    data = [(1, "ОТВОД", "AISI 304L", ("168", None, None), None), (2, "ОТВОД", "AISI 904L", ("168", None, None), None)]
    assert search(spark, ("ОТВОД", "AISI 04L", ("168", None, None)), data, lists, threshold=0.7) == [(1, "FUZZY", True, True), (2, "FUZZY", True, True)]
    inch = [(1, "КРУГ", "304L", ("0.875", None, None), "MM"), (2, "КРУГ", "304L", ("0.875", None, None), "INCH")]
    assert search(spark, ("КРУГ", "304L", ("0.875", None, None), "INCH"), inch, lists) == [(2, "EXACT", False, False)]


def test_limits(spark, lists):
    data = [(i, "КРУГ", "304L", (str(i), None, None), None) for i in range(1, 40)]
    assert len(search(spark, ("КРУГ", "304L", (None, None, None)), data, lists, limit=7)) == 7
    assert search(spark, ("КРУГ", "304L", (None, None, None)), list(reversed(data)), lists, limit=3) == search(spark, ("КРУГ", "304L", (None, None, None)), data, lists, limit=3)
    with pytest.raises(ValueError, match="limit"):
        search(spark, ("КРУГ", "304L", (None, None, None)), data, lists, limit=0)


def test_spellings_and_repeated_items_are_searched_once(spark, lists, monkeypatch):
    written, write = [], search_catalog.materialise
    monkeypatch.setattr(search_catalog, "materialise", lambda df: written.append((table := write(df)).count()) or table)
    spelled = ["".join(x) for x in itertools.product("3", ("", " ", "-", "."), "0", ("", " ", "-", "."), "4", ("", " ", "-", "."), "L")]
    sizes = [("20", "1", None), ("20", "2", None), ("25", "1", None)]
    data = [(i, "КРУГ", grade, size, (None, "MM")[i % 2]) for i, (grade, size) in enumerate(itertools.product(spelled, sizes))]
    asked = [("any", None, None, None), ("20", D(20), None, "MM"), ("24", D(24), None, "MM"), ("inch", D(20), None, "INCH"), ("20x2", D(20), D(2), None), ("25x3", D(25), D(3), None)]
    queries = spark.createDataFrame([(q, "КРУГ", "304 L", a, b, None, unit) for q, a, b, unit in asked], QUERY)
    got = {}
    for r in sorted(catalog_search(queries, stock(spark, data), *lists, limit=9).collect(), key=lambda r: r.position):
        got.setdefault(r.query_id, []).append((r.offer_id, r.match_type))
    # Groups of equal rank (here of either unit) come in the order of their items.
    fit = {"any": range(192), "20": [i for i in range(192) if i % 3 < 2], "20x2": range(1, 192, 3), "inch": [i for i in range(0, 192, 2) if i % 3 < 2]}
    near = {"24": range(2, 192, 3), "25x3": range(1, 192, 3)}
    assert got == {q: [(i, kind) for i in list(ids)[:9]] for kind, of in (("EXACT", fit), ("NEAR_DIMENSION", near)) for q, ids in of.items()}
    assert max(written) <= 6 * 6  # 6 queries and 6 groups, of 192 items in 64 spellings


def test_catalog(spark, lists):
    grades, aliases, relations = lists
    named = spark.createDataFrame([("12x18h10t",), ("c 17200",), ("OLD",), (None,)], "grade string")
    assert sorted(((r.grade or "", r.grade_id, r.resolution) for r in catalog.resolve_names(named, "grade", grades, aliases).collect())) == [
        ("", None, "UNKNOWN"), ("12x18h10t", "g1", "CANONICAL"), ("OLD", None, "UNKNOWN"), ("c 17200", "g2", "ALIAS"),
    ]
    assert rows(catalog.relation_edges(relations).select("a", "b")) == [("g1", "g5"), ("g3", "g1"), ("g5", "g1")]
    bad = grades.unionByName(spark.createDataFrame([("g1", "брб2", "CONFIRMED", None)], grades.schema))
    found = {r.check for r in catalog.catalog_violations(bad, aliases, relations).collect()}
    assert {"repeated_grade_id", "repeated_canonical_key", "confirmed_without_source"} <= found
    assert catalog.catalog_violations(grades, aliases, relations).count() == 0


def test_band_join(spark):
    items = spark.createDataFrame([("К", i, D(str(x))) for i, x in enumerate([1, 1.4, 1.6, 2.1, 9])], "profile string, offer_id long, dim1 decimal(18,6)")
    rules = spark.createDataFrame([("К", D("0.5"))], "profile string, tolerance decimal(18,6)")
    assert rows(catalog.tolerance_pairs(items, rules).select("offer_a", "offer_b")) == [(0, 1), (1, 2), (2, 3)]
