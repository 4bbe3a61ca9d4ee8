from pyspark.sql import functions as F

from sortament.operators.joins import broadcast_if_small, hot_key_join, measured
from sortament.session import is_table, materialise


def test_hot_keys_keep_all_rows(spark):
    left = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 60_000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = hot_key_join(left, right, "k", share=4, least_hot=1_000)
    assert got.count() == 60_000
    assert got.where("k = 7 and w = 14").count() == 30_001 and got.where("k is null and w is null").count() == left.where("k is null").count()
    assert got.where("w is not null").count() == left.join(right, "k").count()


def test_null_and_clean_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k long, v string")
    right = spark.createDataFrame([(1, "x")], "k long, w string")
    assert sorted((tuple(r) for r in hot_key_join(left, right, "k").select("k", "v", "w").collect()), key=repr) == [(1, "a", "x"), (2, "c", None), (None, "b", None)]


def test_broadcast_is_checked(spark):
    small, large = broadcast_if_small(spark.range(5), 5), broadcast_if_small(spark.range(6), 5)
    assert "ResolvedHint" in small._jdf.queryExecution().logical().toString() or "hint" in small._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in large._jdf.queryExecution().logical().toString().lower()


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    few = materialise(spark.range(100).selectExpr("id", "repeat('x', 1000) AS text"))
    assert measured(few, 1000)[0] == 100 and measured(few, 1000)[1] > 100_000 and measured(few, 50)[0] == 51
    assert hinted(broadcast_if_small(few)) and not hinted(broadcast_if_small(few, max_rows=99)) and not hinted(broadcast_if_small(few, max_bytes=50_000))
    assert is_table(broadcast_if_small(spark.range(9), max_rows=1))
