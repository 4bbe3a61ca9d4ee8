import random

from pyspark.sql import functions as F

from sortament.llm.components import connected_components, counted_link, grade_groups
from tests.conftest import rows


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted((v, find(v)) for v in parent)


def check(spark, edges, kind="string"):
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    assert rows(connected_components(df, "a", "b")) == sorted(brute(edges), key=repr)


def test_shapes(spark):
    chain = [(f"v{i:04d}", f"v{i + 1:04d}") for i in range(300)]
    random.seed(2)
    random.shuffle(chain)
    star = [("w500", f"w{i:03d}") for i in range(400)] + [(f"x{i}", "x999") for i in range(40)]
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    check(spark, chain + star + ring + [("a", "a"), ("b", None), (None, "c"), ("d", "e"), ("e", "d"), ("d", "e")])


def test_random_and_longs(spark):
    random.seed(3)
    check(spark, [(random.randrange(400), random.randrange(400)) for _ in range(300)], "long")


def test_empty(spark):
    df = spark.createDataFrame([], "a string, b string, v string, p string")
    assert connected_components(df, "a", "b").count() == 0


def test_counted_links(spark):
    data = [(" equivalent ", "PROPOSED", True), ("EQUIVALENT", "REJECTED", False), ("EQUIVALENT", None, True), (None, "CONFIRMED", False), ("APPROXIMATE", "CONFIRMED", False)]
    df = spark.createDataFrame(data, "relation_type string, status string, want boolean")
    assert df.where(counted_link(F.col("relation_type"), F.col("status")) != F.col("want")).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([("b", "a", "EQUIVALENT", "CONFIRMED", "x", "y")], "source_grade_id string, target_grade_id string, relation_type string, status string, v string, grade_id string")
    assert rows(grade_groups(df)) == [("a", "a"), ("b", "a")]
