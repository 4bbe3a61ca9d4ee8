from decimal import Decimal as D

from pyspark.sql import functions as F

from sortament.functions import size_text
from sortament.operators.candidates import replayed_answers
from sortament.operators.decision_log import invalid_decisions
from sortament.operators.persist import blob_path, read_blobs, store_blobs
from tests.conftest import rows


def test_sequences(spark):
    data = [("Лист 0,8х980х1350-1500 г/к",), ("Труба 70*17.5 + 12x3",), ("36Х29Х8ВН 5x6(7)",), ("4х0,8хБУХТА",), (None,), ("20 мм",)]
    df = spark.createDataFrame(data, "t string")
    assert [r[0] for r in df.select(size_text.size_sequences(F.col("t"))).collect()] == [["0,8х980х1350-1500"], ["70*17.5", "12x3"], ["5x6(7)"], ["4х0,8"], [], []]
    assert [r[0] for r in df.select(size_text.several_sets(F.col("t"))).collect()] == [False, True, False, False, False, False]
    got = spark.range(1).select(size_text.sequence_parts(F.lit("0,8 х 980 х 1350-1500"))).first()[0]
    assert [tuple(p) for p in got] == [(D("0.8"), None), (D(980), None), (D(1350), "1350-1500")]


def test_wall(spark):
    df = spark.createDataFrame([(D(20), D(15)), (D(5), D(5)), (None, D(1))], "a decimal(18,6), b decimal(18,6)")
    assert [r[0] for r in df.select(size_text.wall_of_tube(F.col("a"), F.col("b"))).collect()] == [D("2.5"), None, None]


def test_replay(spark):
    sent = spark.createDataFrame([(1, "p"), (2, "q")], "offer_id long, payload string")
    recorded = sent.where("offer_id = 1").select(F.sha2("payload", 256).alias("payload_hash"), F.lit("a").alias("answer"))
    assert rows(replayed_answers(sent, recorded)) == [(1, "a"), (2, None)]


def test_decisions(spark):
    data = [(1, "o", "c", "KEEP", None, None, None, None), (2, " ", None, "X", None, None, "0", ""), (3, "o", "c", "UPDATE", "r", None, "1,5", "x"), (4, "o", "c", "DEFER", None, None, "nan", None)]
    log = spark.createDataFrame(data, "decision_id long, operator string, comment string, action string, rule_id string, rule_version string, dim1 string, grade string")
    assert rows(invalid_decisions(log, ("dim1",), ("grade",))) == sorted([(2, "operator"), (2, "comment"), (2, "action"), (2, "dim1"), (2, "grade"), (3, "rule"), (4, "dim1")], key=repr)


def test_blobs(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"ab"),), (bytearray(b"ab"),), (bytearray(b""),), (None,)], "c binary")
    for _ in range(2):
        stored = {r["size"]: r for r in store_blobs(df, "c", str(tmp_path / "b")).collect()}
        assert set(stored) == {0, 2} and stored[2]["path"].endswith(f"/part={stored[2]['digest'][:2]}")
        assert spark.read.parquet(stored[2]["path"]).first().content == b"ab"
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    wanted = spark.createDataFrame([(stored[2]["digest"],), ("0" * 64,)], "digest string")
    assert [(r.digest, bytes(r.content)) for r in read_blobs(spark, str(tmp_path / "b"), wanted).collect()] == [(stored[2]["digest"], b"ab")]
    assert spark.range(1).select(blob_path("x", F.lit("abcd"))).first()[0] == "x/part=ab"
