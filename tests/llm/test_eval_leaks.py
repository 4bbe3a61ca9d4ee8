import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sortament.llm.eval_leaks import leak_matches, leaked_items
from tests.conftest import rows

WORD = re.compile(r"[^\W_]+")
DOCS, ITEMS = "doc_id long, text string, term string, item string", "item_id long, passage string, doc string"


def brute(docs, items, run):
    out = set()
    for i, p in items:
        w = WORD.findall((p or "").lower())
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for d, t in docs:
            v = WORD.findall((t or "").lower())
            if d is not None and any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                out.add((i, d))
    return sorted(out)


def check(spark, docs, items, run):
    got = leaked_items(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, "z") for i in items], ITEMS), run=run)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items, run)


def test_cases(spark):
    passage = "один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать"
    words = passage.split()
    docs = [
        (1, "начало " + " ".join(words[:12]).upper() + " конец"), (2, " ".join(words[:11]) + " иначе"), (3, "> " + "\n> ".join(w + "," for w in words)), (4, None), (5, ""),
        (6, " ".join(words[:6] + ["лишнее"] + words[6:])), (7, "_".join(words)), (7, "_".join(words)), (8, "x " * 50_000 + passage), (None, passage),
    ]
    items = [(1, passage), (2, "слишком короткий отрывок"), (3, None), (4, passage + " ещё " + passage), (5, "а " * 13)]
    check(spark, docs, items, 12)


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_like_brute_force(spark, seed):
    random.seed(seed)
    text = lambda n: " ".join(random.choices("абвг", k=n))
    check(spark, [(i, text(random.randint(0, 40))) for i in range(25)], [(i, text(random.randint(0, 14))) for i in range(6)], 5)


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "а б в", "x", "y")], DOCS)
    assert leaked_items(docs, items).count() == leaked_items(some, items).count() == 0


def test_matches(spark):
    docs = spark.createDataFrame([(1, "a b c d x f", "x", "y")], DOCS)
    items = spark.createDataFrame([(9, "a b c d e f", "z")], ITEMS)
    assert rows(leak_matches(docs, items, run=3)) == [(9, 1, "EXACT", 4, 4, 0.666667)]
    assert leak_matches(docs.where("false"), items).count() == leak_matches(docs, items.where("false")).count() == 0


def test_altered_passages_are_near(spark):
    words = [f"w{i}" for i in range(14)]
    swap = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    docs = [
        (1, swap(3, 9)), (2, swap(3, 6, 9)), (3, " ".join(words[:6] + ["in", "between"] + words[6:])), (4, " ".join(words[:7] + words[8:])),
        (5, " ".join(words[:6] + ["x"] * 9 + words[6:])), (6, "begin " + " ".join(words) + " end"), (7, " ".join(reversed(words))), (8, None),
    ]
    got = leak_matches(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(9, " ".join(words), "z"), (10, None, "z")], ITEMS))
    assert {r.doc_id: (r.kind, r.words, r.longest_run) for r in got.collect()} == {1: ("NEAR", 12, 5), 3: ("NEAR", 14, 8), 4: ("NEAR", 13, 7), 6: ("EXACT", 14, 14)}


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_altered_passages_like_brute_force(spark, seed):
    pick = random.Random(seed)
    items = [(i, [pick.choice("абвгде") for _ in range(pick.randint(4, 12))]) for i in range(5)]
    docs = []
    for d in range(20):
        base = list(pick.choice(items)[1])
        for _ in range(pick.randint(0, 3)):
            base[pick.randrange(len(base))] = pick.choice("абвгде")
        docs.append((d, [pick.choice("абвгде") for _ in range(pick.randint(0, 5))] + base))
    run, missing = 6, 1
    want = set()
    for i, a in items:
        for d, b in docs:
            for shift in range(-len(a), len(b)):
                same = [0 <= k + shift < len(b) and a[k] == b[k + shift] for k in range(len(a))]
                if any(sum(same[k : k + run]) >= run - missing for k in range(len(a) - run + 1)):
                    want.add((i, d))
    df = spark.createDataFrame([(d, " ".join(b), "x", "y") for d, b in docs], DOCS)
    got = leak_matches(df, spark.createDataFrame([(i, " ".join(a), "z") for i, a in items], ITEMS), run=run, missing=missing, slack=0)
    assert {(r.item_id, r.doc_id) for r in got.collect()} == want
