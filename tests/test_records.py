from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from sortament.operators import decision_log
from sortament.operators import decision_log as log
from sortament.operators import documents, evidence, mail, metrics
from sortament.operators.persist import append_once, bundle_hash, stable_id
from tests.conftest import rows

LOG = "offer_id long, decision_id long, decision_status string, source_fingerprint string, grade string, resolved_review_reasons array<string>"
ITEMS = "offer_id long, grade string, source_fingerprint string, review_reasons array<string>, requires_review boolean"


def test_latest_and_previous(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 9, "z")], "k long, n long, v string")
    assert rows(log.latest(df, "k", "n").select("k", "v")) == [(1, "c"), (2, "z")]
    assert rows(log.with_previous(df, "k", "n", "n").select("n", "previous_id")) == sorted([(1, None), (2, 1), (3, 2), (9, None)], key=repr)


def test_apply_latest(spark):
    decisions = spark.createDataFrame(
        [(1, 1, "CONFIRMED", "f1", "OLD", ["a"]), (1, 2, "CONFIRMED", "f1", "NEW", ["a"]), (2, 1, "CONFIRMED", "other", "X", []), (3, 1, "DEFERRED", "f3", "X", ["a"]), (9, 1, "CONFIRMED", "f", "X", [])], LOG
    )
    items = spark.createDataFrame([(1, "g", "f1", ["a", "a", "b"], True), (2, "g", "f2", ["a"], True), (3, "g", "f3", ["a"], True), (4, "g", "f4", [], False)], ITEMS)
    got = {r.offer_id: (r.grade, r.review_reasons, r.requires_review, r.apply_status) for r in log.apply_latest(items, decisions, "offer_id", ("grade",), "decision_id").collect()}
    assert got == {1: ("NEW", ["b"], True, "APPLIED"), 2: ("g", ["a"], True, "SKIPPED_SOURCE_MISMATCH"), 3: ("g", ["a"], True, None), 4: ("g", [], False, None)}
    assert rows(log.unmatched_decisions(decisions, items, "offer_id").select("offer_id")) == [(9,)]
    once = log.apply_latest(items, decisions, "offer_id", ("grade",), "decision_id").drop("apply_status")
    assert rows(log.apply_latest(once, decisions, "offer_id", ("grade",), "decision_id").drop("apply_status")) == rows(once)


def test_queue(spark):
    queue = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    df = spark.createDataFrame([(1, 1, "DEFER"), (1, 2, "CONFIRM"), (2, 1, "DEFER")], "k long, n long, action string")
    states = log.queue_states(queue, df, "k", "action", "n")
    assert rows(states) == [(1, "RESOLVED"), (2, "DEFERRED"), (3, "UNRESOLVED")]
    assert tuple(log.state_counts(states).first()) == (3, 1, 1, 2)


def test_append_new(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c"), (None, "d"), (None, "e")], "k long, v string")
    assert rows(log.append_new(old, new, "k")) == sorted([(2, "c"), (None, "d"), (None, "e")], key=repr)


PROPOSALS = (
    "row_id long, current_profile string, current_grade string, current_dim1 string, current_dim2 string, current_dim3 string, profile string, grade string, "
    "dim1 string, dim2 string, dim3 string, sources array<string>, confidence double, evidence_basis string, research_required boolean"
)


def proposals(spark):
    source = ["Труба БрБ2 ф20,5 г/к"]
    return spark.createDataFrame(
        [
            (1, "ТРУБА", "предпол.", "20.50", None, None, "ТРУБА", "БРБ2", "20,5", None, None, source, 0.9, "SOURCE", False),
            (2, "ТРУБА", "БРБ2", "20", None, None, "ТРУБА", "БРБ2", "20.5", None, None, source, 0.9, "SOURCE", False),
            (3, "ТРУБА", "брб2", "20", None, None, "ТРУБА", "БРБ2", "20", None, None, source, 0.9, "SOURCE", False),
            (4, "ТРУБА", "X", "20", None, None, "ТРУБА", "БРБ2", "20", None, None, source, 0.7, "SOURCE", False),
            (5, "ТРУБА", "X", "20", None, None, "ТРУБА", "БРБ3", "20", None, None, source, 0.9, "SOURCE", False),
            (6, "ТРУБА", "X", "20", None, None, "ТРУБА", "БРБ2", "20", None, None, source, 0.9, "MODEL_KNOWLEDGE", False),
        ],
        PROPOSALS,
    )


EVIDENCE = [(1, "grade", "брб2"), (2, "dim1", "ф20,5"), (4, "grade", "БрБ2"), (5, "grade", "БрБ2"), (6, "grade", "БрБ2")]


def test_evidence(spark):
    checked = evidence.check_proposals(proposals(spark), spark.createDataFrame(EVIDENCE, "row_id long, field string, quote string"))
    got = {r.row_id: (r.changed, r.confirmed, r.rejected, r.decision) for r in checked.collect()}
    assert got[1] == (["grade"], ["grade"], [], "PROPOSE_CHANGE")
    assert got[2] == (["dim1"], ["dim1"], [], "PROPOSE_CHANGE")
    assert got[3] == ([], [], [], "KEEP")
    assert got[4][3] == got[6][3] == "REVIEW" and got[5] == (["grade"], [], ["grade"], "REVIEW")
    items = spark.createDataFrame([(1, "ТРУБА", "предпол.", "20.50", None, None, 0.5), (5, "ТРУБА", "X", "20", None, None, 0.99)], "row_id long, profile string, grade string, dim1 string, dim2 string, dim3 string, confidence double")
    assert rows(evidence.apply_confirmed(items, proposals(spark), checked).select("row_id", "grade", "confidence")) == [(1, "БРБ2", 0.9), (5, "X", 0.99)]


def test_bag_of_ids(spark):
    sent, got = (spark.createDataFrame([(x,) for x in ids], "id long") for ids in ([1, 2, 3], [2, 3, 3, 4]))
    assert rows(evidence.id_differences(sent, got, "id")) == [(1, "MISSING"), (3, "DUPLICATE"), (4, "UNEXPECTED")]


def test_document_totals(spark):
    lines = spark.createDataFrame([(1, D(10), D(100), D(20))], "k long, quantity decimal(18,3), unit_price decimal(18,2), markup_rate decimal(5,2)")
    heads = spark.createDataFrame([(1, D(500), D(1000), D(20), False), (2, D(0), D(120), D(20), True)], "k long, discount decimal(18,2), delivery decimal(18,2), vat_rate decimal(5,2), prices_include_vat boolean")
    assert rows(documents.document_totals(lines, heads, "k")) == [(1, D(1200), D(1700), D(340), D(2040)), (2, D(0), D(120), D(20), D(120))]


def test_versions(spark):
    old = spark.createDataFrame([("a", "h1", 1), ("a", "h2", 2)], "document_key string, content_hash string, version long")
    new = spark.createDataFrame([("a", "h1"), ("a", "h3"), ("b", "h9")], "document_key string, content_hash string")
    assert rows(documents.next_versions(old, new)) == [("a", "h1", 1), ("a", "h3", 3), ("b", "h9", 1)]


def test_mail_links(spark):
    requests = spark.createDataFrame([("r1", "M1@x", "T1"), ("r2", "m2@x", "T2")], "request_id string, message_id string, token string")
    data = [("a", "<m1@X>", None, "s"), ("b", None, "<m1@x> <m2@x>", "s"), ("c", None, None, "Re: [PPREQ:T2] s"), ("d", "<no@x>", "<q@x>", "s"), ("e", None, None, None)]
    messages = spark.createDataFrame(data, "message_key string, in_reply_to string, references string, subject string")
    assert rows(mail.link_replies(messages, requests)) == sorted(
        [("a", "r1", "IN_REPLY_TO"), ("b", "r2", "REFERENCES"), ("c", "r2", "REQUEST_TOKEN"), ("d", None, None), ("e", None, None)], key=repr
    )


def test_attachments_and_retries(spark):
    data = [("a.xlsx", b"PK\x03\x04zz"), ("a.xlsx", b"no"), ("b.exe", b"MZ"), ("c.csv", b"x" * 50)]
    df = spark.createDataFrame(data, "n string, c binary")
    assert [r[0] for r in df.select(mail.attachment_status(F.col("n"), F.col("c"), most_bytes=40)).collect()] == ["ACCEPTED", "REJECTED_CONTENT", "REJECTED_EXTENSION", "REJECTED_SIZE"]
    states = spark.createDataFrame([("RETRY", 1), ("RETRY", 2), ("SENT", 9)], "s string, n int").select(mail.retry_state(F.col("s"), F.col("n"))).collect()
    assert [r[0] for r in states] == ["RETRY", "DEAD_LETTER", "SENT"]


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k long, f string, g string")
    got = spark.createDataFrame([(1, "a", None), (2, "c", "x"), (3, "q", "q")], "k long, f string, g string")
    accuracy = metrics.field_accuracy(got, gold, "k", ("f", "g"))
    assert rows(accuracy) == [("f", 2, 1, 0.5), ("g", 2, 2, 1.0)]
    assert tuple(metrics.gate(accuracy, 0.95).first()) == (False, "f")
    checks = spark.createDataFrame([("VERIFIED",), ("BLOCKED",)], "status string")
    assert metrics.check_status(checks).first()[0] == "READY_WITH_LIMITATIONS"
    cost = metrics.token_cost(spark.createDataFrame([("m", 10, 20), ("m", 5, 0)], "model string, input_tokens long, output_tokens long"), spark.createDataFrame([("m", 0.75, 4.5)], "model string, per_million_in double, per_million_out double"))
    assert rows(cost) == [("m", 15, 20, 0.000101)]


def test_batches(spark):
    got = metrics.in_batches(spark.range(0, 103, numPartitions=5), 10, "id").collect()
    assert sorted((r.id, r.batch) for r in got) == [(i, i // 10) for i in range(103)]


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "h1"), (2, "h2"), (2, "h2")], "k long, h string")
    assert append_once(spark, path, df, "k", "h") == 2
    assert append_once(spark, path, df, "k", "h") == 0
    with pytest.raises(ValueError, match="another payload"):
        append_once(spark, path, spark.createDataFrame([(1, "other")], "k long, h string"), "k", "h")


def test_bundle_and_ids(spark):
    files = spark.createDataFrame([("x/b", bytearray(b"2")), ("y/a", bytearray(b"1"))], "path string, content binary")
    assert bundle_hash(files) == bundle_hash(files.orderBy("path"))
    assert spark.range(1).select(stable_id("of", F.lit("x"), 6)).first()[0] == "of-2d7116"


def test_rates_of_rows(spark):
    schema = "k int, a string, b int, requires_review boolean"
    results = spark.createDataFrame([(1, "x", 1, True), (2, "y", None, False), (3, "z", 3, True), (9, "w", 1, True)], schema)
    gold = spark.createDataFrame([(1, "x", 1, False), (2, "y", None, False), (3, "z", 4, True)], schema)
    assert tuple(metrics.row_accuracy(results, gold, "k", ("a", "b")).first()) == (3, 2, 0.6667, 1, 0.3333)
    assert tuple(metrics.row_accuracy(results.where("false"), gold, "k", ("a",)).first()) == (0, 0, None, 0, None)


def test_summary_of_reconciling(spark):
    schema = "decision string, final_decision string, removed_warnings array<string>, warnings array<string>"
    df = spark.createDataFrame([("keep", "KEEP", ["a"], []), ("REVIEW", "KEEP", None, ["b", "c"]), (None, "KEEP", [], [])], schema)
    assert tuple(metrics.reconciliation_summary(df).first()) == (3, 2, 1, 2, 0.3333)
    assert tuple(metrics.reconciliation_summary(df.where("false")).first()) == (0, 0, 0, 0, None)


def test_manifest_and_places(spark):
    batches = metrics.in_batches(spark.range(5).withColumnRenamed("id", "k"), 2, "k")
    answers = spark.createDataFrame([(0,), (1,), (1,), (4,), (None,), (77,)], "k long")
    assert rows(metrics.batch_manifest(batches, answers, "k")) == [(0, 2, 2, True), (1, 2, 0, False), (2, 1, 1, True)]
    df = spark.createDataFrame([("b", 2), ("a", 9), ("a", 1), (None, 0)], "file string, row int")
    got = metrics.positional_ids(df, "parsed", 6, "file", "row").orderBy("id").collect()
    assert [(r.id, r.file, r.row) for r in got] == [("parsed-000001", None, 0), ("parsed-000002", "a", 1), ("parsed-000003", "a", 9), ("parsed-000004", "b", 2)]
    assert metrics.positional_ids(df.where("false"), "p", 3, "file").count() == 0


def test_queues_and_orders(spark):
    df = spark.createDataFrame([(1, True, ["grade_conflict", "x"]), (2, True, None), (3, False, ["x"]), (4, True, [])], "k int, requires_review boolean, review_reasons array<string>")
    assert rows(decision_log.review_queues(df).select("k", "normalisation", "any_reason")) == [(1, True, True), (2, None, False), (4, False, False)]
    df = spark.createDataFrame([("a", 1, 1), ("a", 3, 2), ("b", 2, 1), ("b", 1, 2), ("c", None, 1), ("c", 1, 2)], "g string, v int, o int")
    assert rows(metrics.in_order(df, "g", "v", "o")) == [("a", True), ("b", False), ("c", True)]


def test_prices_of_models(spark):
    usage = spark.createDataFrame([("m-1-mini", 10, 5), ("m-1-mini", 990_000, 0), ("m-1", 1_000_000, 1_000_000), ("x", 1, 1)], "model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m-1", 2.0, 4.0), ("m-1-mini", 0.5, 1.0)], "model string, per_million_in double, per_million_out double")
    assert rows(metrics.token_cost(usage, prices)) == [("m-1", 1_000_000, 1_000_000, 6.0), ("m-1-mini", 990_010, 5, 0.49501), ("x", 1, 1, None)]
    first = prices.withColumn("ordinal", F.when(F.col("model") == "m-1", 0).otherwise(1))
    assert rows(metrics.token_cost(usage.where("model = 'm-1-mini'"), first).select("cost")) == [(1.98004,)]


def test_stats_of_a_search(spark):
    hits = spark.createDataFrame([("E", D(1), "b"), ("N", None, "a"), ("N", D(2), "a")], "match_type string, price_rub_kg decimal(18,4), supplier string")
    assert tuple(metrics.search_stats(hits, "E").first()) == (3, 1, 2, 2, 1, ["a", "b"])


def test_codes_of_evidence(spark):
    schema = "row_id int, current_grade string, grade string, current_material string, material string, sources array<string>, confidence double, evidence_basis string, research_required boolean"
    data = [(i, "A1", "Б2", "СТАЛЬ", "СТАЛЬ", ["пруток Б2"], 0.9, "SOURCE", False) for i in range(4)] + [(9, "A1", "A1", "СТАЛЬ", "титан", ["лист Титан"], 0.9, "SOURCE", False)]
    quotes = [(0, "grade", "Б2"), (0, "grade", "другое"), (1, "grade", "пруток"), (2, "grade", "Б2 х"), (9, "material", "титан")]
    got = {r.row_id: (r.codes, r.decision) for r in evidence.check_proposals(spark.createDataFrame(data, schema), spark.createDataFrame(quotes, "row_id int, field string, quote string")).collect()}
    assert got == {
        0: (["grade:CONFIRMED"], "PROPOSE_CHANGE"), 1: (["grade:VALUE_NOT_STATED"], "REVIEW"), 2: (["grade:NOT_IN_SOURCE"], "REVIEW"), 3: (["grade:NO_EVIDENCE"], "REVIEW"), 9: (["material:CONFIRMED"], "PROPOSE_CHANGE"),
    }
