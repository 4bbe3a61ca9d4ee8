import pytest
from pyspark.sql import functions as F

from sortament.llm.mixing import VOCABULARY, _rate, fit_domains, held_out_accuracy, measure, mix, mixture_copies, mixture_report
from tests.conftest import rows

TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.range(600).withColumn("source", F.when(F.col("id") < 400, "big").when(F.col("id") < 550, "mid").when(F.col("id") < 580, "small"))
    word = F.when(F.col("id") < 400, "труба лист круг").when(F.col("id") < 550, "the invoice came today").otherwise("keine Ahnung wovon")
    return base.select(F.col("id").alias("doc_id"), "source", F.repeat(F.concat(word, F.lit(" ")), (F.col("id") % 7 + 3).cast("int")).alias("text"), F.lit(1).alias("member"))


def test_shares(spark, docs):
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 3), ("small", 0.2, 2), ("none", 0.0, 1)], TARGETS)
    m = mix(docs.unionByName(spark.createDataFrame([(1000, "big", None, 1), (1001, "alien", "a b", 1), (None, "big", "x", 1)], "doc_id long, source string, text string, member int")), targets)
    report = {r.source: r for r in mixture_report(m).collect()}
    for s in ("big", "mid"):
        assert abs(report[s].reached_share - 0.4) < 0.004
    assert report["small"].most_copies == 2 and abs(report["small"].reached_share - 0.2) < 0.004
    assert report["none"].used_tokens == 0
    copies = mixture_copies(m)
    assert copies.where("doc_id in (1000, 1001)").count() == 0
    caps = {"big": 1, "mid": 3, "small": 2}
    assert all(r.copies <= caps[r.source] for r in copies.collect())
    assert sum(r.used_tokens for r in report.values()) == copies.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]


def test_unlabelled_documents_follow_their_posteriors(spark, docs):
    classifier = fit_domains(docs, ("big", "mid", "small"))
    found = measure(docs.where("source is null"), classifier).withColumn("best", F.array_position("posterior", F.array_max("posterior")))
    assert found.where("best = 3").count() == found.count() == 20


def test_held_out_accuracy(spark, docs):
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and source is not null")
    domains = ("big", "mid", "small")
    names = F.array(*[F.lit(d) for d in domains])
    found = measure(test, fit_domains(train, domains)).withColumn("best", F.array_position("posterior", F.array_max("posterior")).cast("int"))
    assert found.where(F.element_at(names, F.col("best")) == F.col("source")).count() >= 0.95 * found.count()


def test_tokens_round_trip(spark, docs):
    from tests.llm.tokenizer import encode

    got = {r.doc_id: r.tokens for r in measure(docs.limit(20), fit_domains(docs, ("big", "mid"))).collect()}
    texts = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin(list(got))).collect()}
    assert got == {i: len(encode(VOCABULARY, t)) for i, t in texts.items()}


def test_steps_stay_in_the_box(spark):
    df = spark.createDataFrame([([1.0, 0.0], 1.0), ([0.5, 0.5], 2.0), ([0.0, 1.0], 0.0)], "member array<double>, cap double")
    history = [[-5.0, 1.0], [0.3, 0.0]]
    want = []
    for member, cap in df.collect():
        rate = min(1.0, cap)
        for h in history:
            rate = min(max(rate - sum(m * r for m, r in zip(member, h, strict=True)), 0.0), cap)
        want.append(rate)
    assert [r[0] for r in df.select(_rate(history)).collect()] == pytest.approx(want)
    assert [r[0] for r in df.select(_rate([])).collect()] == [1.0, 1.0, 0.0]


def test_posteriors_of_labelled_documents(spark, docs):
    """Where the wording tells sources apart, both memberships reach the shares."""
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.4, 3), ("small", 0.1, 3)], TARGETS)
    m = mix(docs, targets, labels=False)
    assert all(abs(r.reached_share - r.target_share) < 0.05 for r in mixture_report(m).collect())
    assert held_out_accuracy(docs, ("big", "mid"), per_source=50)[0] > 0.95


def test_empty(spark, docs):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert mixture_copies(mix(docs.where("false"), targets)).count() == 0
    assert rows(mixture_report(mix(docs.where("false"), targets)).select("source", "used_tokens")) == [("big", 0)]
    assert mixture_copies(mix(docs, targets.where("false"))).count() == 0
