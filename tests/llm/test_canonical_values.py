import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sortament.functions.text import CYRILLIC_TWINS, LATIN_TWINS
from sortament.llm.canonical_values import LEAST_SCORE, grade_entries, match_grades, match_values
from tests.conftest import rows

GRADES = [("gr-1", "12Х18Н10Т"), ("gr-2", "ЛД572-2АЕ"), ("gr-3", "12Х18Н9Т"), ("gr-4", None), ("gr-5", "Ст45")]
ALIASES = [("al-1", "LIGIZ 912K", "gr-2"), ("al-2", "AISI 321", "gr-1"), ("al-3", None, "gr-1"), ("al-4", "FOO99", None)]


@pytest.fixture(scope="module")
def lists(spark):
    return (
        spark.createDataFrame([(*g, "CONFIRMED") for g in GRADES], "grade_id string, canonical string, status string"),
        spark.createDataFrame(ALIASES, "alias_id string, alias string, canonical_grade_id string"),
    )


def test_cases(spark, lists):
    cases = {
        "12Х18Н10Т": None, "12x18h10t": "gr-1", "сталь 12Х18 Н10Т": "gr-1", "12X1N10Т": "gr-1", "гр. ЛД57-2-АЕ": "gr-2", " ligiz912 k": "gr-2", "LIGZ 91K": "gr-2",
        "LIZ 91K": "UNMATCHED", "12Х18Н9": "gr-3", "Aisi-321": "gr-1", "предпол.": None, "": None, "  ": None, None: None, "?": "UNMATCHED", "ст45": "gr-5", "сталь ст45": "gr-5",
        "x" * 5000: "UNMATCHED", "FOO99": "UNMATCHED",
    }
    data = [(i, c, "q", "t") for i, c in enumerate(cases)]
    offers = spark.createDataFrame([*data, data[1]], "offer_id long, grade string, value string, token string")
    want = [(i, g) for i, g in enumerate(cases.values()) if g]
    assert rows(match_grades(offers, *lists)) == sorted([*want, want[0]], key=repr)
    assert match_grades(offers.where("false"), *lists).count() == 0
    none = lists[0].where("false"), lists[1].where("false")
    assert {r.grade_id for r in match_grades(offers, *none).collect()} == {"UNMATCHED"}


def fold(text):
    return re.sub(r"[^0-9A-ZА-Я]", "", text.upper().translate(str.maketrans(CYRILLIC_TWINS, LATIN_TWINS)))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10**6))
def test_nearest_like_brute_force(spark, seed):
    random.seed(seed)
    letters = "АБЗХ12-"
    names = sorted({"".join(random.choices(letters, k=random.randint(3, 7))) for _ in range(30)})
    names = [n for n in names if fold(n)]
    values = ["".join(random.choices(letters, k=random.randint(1, 8))) for _ in range(120)]
    entries = spark.createDataFrame([(f"e{i:02d}", n, 0) for i, n in enumerate(names)], "entry_id string, name string, rank int")
    df = spark.createDataFrame(list(enumerate(values)), "id long, v string")
    got = {r.id: r.entry_id for r in match_values(df, "id", "v", entries, part_of_length=None, least_score=None).collect()}
    for i, v in enumerate(values):
        if v in names:
            assert i not in got
            continue
        best = min((distance(fold(v), fold(n)) for n in names))
        assert (got[i] is None) == (best > 2 or not fold(v)), (v, got[i])
        if got[i]:
            assert distance(fold(v), fold(names[int(got[i][1:])])) == best


def test_ties_go_to_names_then_ids(spark):
    entries = spark.createDataFrame([("b", "ABCDE1", 0), ("a", "ABCDE2", 0), ("0", "ABCDE3", 1)], "entry_id string, name string, rank int")
    df = spark.createDataFrame([(1, "ABCDE9")], "id long, v string")
    assert rows(match_values(df, "id", "v", entries)) == [(1, "ABCDE9", "a")]


def test_entries(spark, lists):
    assert grade_entries(*lists).where("rank = 0").count() == len(GRADES)


TOWNS = ["Нижний Новгород", "Санкт Петербург", "ЮГ", "Ростов на Дону", "Новгород", "Верхний Тагил", "Нижний Тагил", "Ростов Великий"]


def test_words_in_any_order_are_repaired(spark):
    entries = spark.createDataFrame([(f"t{i}", t, 0) for i, t in enumerate(TOWNS)], "entry_id string, name string, rank int")
    cases = {
        "Нижнй Навгороп": "Нижний Новгород", "Петербург Санкт": "Санкт Петербург", "Питербург, Санкт": "Санкт Петербург", "ИЛ": None, "юг": "ЮГ", "Ю": None, "Новгорд": "Новгород",
        "тагил нижний": "Нижний Тагил", "Дону на Ростове": "Ростов на Дону", "Ростов": None, "Великий Устюг": None, "Нижний": None, "Москва": None, "НовгородНижний": None,
        "Нижний " * 500: None, "слово " * 3000: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, v string")
    got = {r.id: r.entry_id for r in match_values(df, "id", "v", entries).collect()}
    names = {None: None} | {f"t{i}": t for i, t in enumerate(TOWNS)}
    assert {v: names[got[i]] for i, v in enumerate(cases)} == cases


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10**6))
def test_words_like_brute_force(spark, seed):
    """All pairs of value and entry, by the same rule."""
    import math

    pick = random.Random(seed)
    words = ["".join(pick.choices("абвгд", k=pick.randint(2, 7))) for _ in range(12)]
    names = sorted({" ".join(pick.sample(words, pick.randint(1, 3))) for _ in range(20)})

    def typo(w):
        at = pick.randrange(len(w))
        return w[:at] + pick.choice("абвгд") + w[at + pick.randint(0, 1) :]

    values = sorted({" ".join(typo(w) if pick.random() < 0.4 else w for w in pick.sample(words, pick.randint(1, 4))) for _ in range(60)} - set(names))
    entries = spark.createDataFrame([(f"e{i:02d}", n, 0) for i, n in enumerate(names)], "entry_id string, name string, rank int")
    df = spark.createDataFrame(list(enumerate(values)), "id long, v string")
    got = {r.id: r.entry_id for r in match_values(df, "id", "v", entries).collect()}
    folded = {n: list(dict.fromkeys(fold(w) for w in n.split())) for n in names}
    weight = {w: math.log1p(len(names) / sum(w in f for f in folded.values())) for f in folded.values() for w in f}
    top = max(weight.values())
    near = lambda a, b: distance(a, b) <= min(2, int(max(len(a), len(b)) * 0.34))
    for i, v in enumerate(values):
        whole, said = fold(v), list(dict.fromkeys(fold(w) for w in v.split()))
        if any(fold(n) == whole for n in names):
            continue
        heft = sum(max([weight[w] for w in weight if near(w, s)], default=top) for s in said)
        best = []
        for k, n in enumerate(names):
            edits = distance(whole, fold(n))
            edits = edits if near(whole, fold(n)) else None
            score = sum(weight[w] * max([1 - distance(w, s) / max(len(w), len(s)) for s in said if near(w, s)], default=0) for w in folded[n])
            score = round(score / max(heft, sum(weight[w] for w in folded[n])), 9)
            if edits is not None or score >= LEAST_SCORE:
                best.append((3 if edits is None else edits, -score, f"e{k:02d}"))
        assert got[i] == (min(best)[2] if best else None), (v, got[i], sorted(best)[:3])
