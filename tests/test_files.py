import json

import pytest
from pyspark.sql import functions as F

from sortament.operators.bundles import import_bundle, store_counts
from sortament.operators.candidates import candidates, mock_answers, payload, reconcile
from sortament.sources.catalog_files import BadFile, read_catalog, read_inventory
from sortament.sources.exports import export_offers
from sortament.sources.xlsx import read_cells
from sortament.tables import read_table
from tests.conftest import rows

GRADE = {"id": "g1", "canonical": "БРБ2", "status": "CONFIRMED", "source_reference": "x", "standard_system": None}
ALIAS = {"id": "a1", "alias": "C17200", "canonical_grade_id": "g1", "status": "CONFIRMED", "source_reference": "x"}
RELATION = {"id": "e1", "source_grade_id": "g1", "target_grade_id": "g2", "relation_type": "APPROXIMATE", "status": "PROPOSED", "source_reference": "x", "bidirectional": True}


def lines(path, *objects):
    path.write_text("".join(json.dumps(o, ensure_ascii=False) + "\n" for o in objects), encoding="utf-8")


def test_catalog(spark, tmp_path):
    lines(tmp_path / "grades.jsonl", GRADE, GRADE | {"id": "g2", "canonical": "М1"})
    lines(tmp_path / "aliases.jsonl", ALIAS)
    lines(tmp_path / "equivalences.jsonl", RELATION)
    catalog = read_catalog(spark, str(tmp_path))
    assert (catalog.grades.count(), catalog.aliases.count(), catalog.relations.count()) == (2, 1, 1)
    lines(tmp_path / "aliases.jsonl", ALIAS | {"canonical_grade_id": "no"})
    with pytest.raises(BadFile, match="alias_without_grade"):
        read_catalog(spark, str(tmp_path))
    lines(tmp_path / "aliases.jsonl", ALIAS | {"more": 1})
    with pytest.raises(BadFile, match="unknown_field"):
        read_catalog(spark, str(tmp_path))


def test_inventory(spark, tmp_path):
    item = {"id": "i1", "supplier": "s", "profile": "ТРУБА", "grade": "М1", "dimensions": ["7/8", "1,5"], "source_reference": "r", "payload": {"a": "1"}, "dimension_units": ["INCH", "MM"]}
    lines(tmp_path / "i.jsonl", item)
    row = read_inventory(spark, str(tmp_path / "i.jsonl")).first()
    assert (float(row.dim1), float(row.dim2), row.dim3, row.dim1_unit, row.payload) == (0.875, 1.5, None, "INCH", {"a": "1"})
    lines(tmp_path / "i.jsonl", item, item)
    with pytest.raises(BadFile, match="twice"):
        read_inventory(spark, str(tmp_path / "i.jsonl"))


def test_export(spark, folder, tmp_path):
    offers = read_table(spark, folder, "offers")
    export_offers(offers, str(tmp_path / "o.xlsx"), search=offers.limit(3).withColumn("match_type", F.lit("ТОЧНОЕ")).withColumn("size_delta", F.lit(0.0)))
    cells = read_cells(spark, str(tmp_path))
    assert cells.where("sheet_ix = 0").count() == offers.count() + 1 and cells.where("sheet_ix = 1").count() == 4


def test_bundle(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    items = [{"id": "o1", "supplier": " Р ", "grade": "М1"}, {"id": "o2", "supplier": "р", "grade": None}]
    lines(folder / "normalized_items.jsonl", *items)
    lines(folder / "normalization_review_queue.jsonl", items[1])
    first, second = (import_bundle(spark, str(folder), store) for _ in range(2))
    assert first.written == {"offers": 2, "suppliers": 1, "review_items": 1, "audit_events": 1}
    assert second.job_id == first.job_id and set(second.written.values()) == {0}
    assert dict(rows(store_counts(spark, store))) == {"offers": 2, "suppliers": 1, "review_items": 1, "audit_events": 1}
    lines(folder / "normalized_items.jsonl", items[0] | {"grade": "other"}, items[1])
    with pytest.raises(ValueError, match="another payload"):
        import_bundle(spark, str(folder), store)
    lines(folder / "normalization_review_queue.jsonl", {"id": "o9"})
    with pytest.raises(ValueError, match="no offer"):
        import_bundle(spark, str(folder), store)


def test_candidates(spark):
    data = [(1, "предпол.", ["a", "a"], True, 0.5), (2, "М1", [], True, 1.0), (3, "М1", None, False, 0.8), (4, "М1", [], False, 0.95)]
    offers = spark.createDataFrame(data, "offer_id long, grade string, review_reasons array<string>, requires_review boolean, confidence double")
    assert {r.offer_id: r.reasons for r in candidates(offers).collect()} == {1: ["a", "unconfirmed_grade"], 2: ["manual_review_required"], 3: ["low_validation_score"]}
    more = offers.select("*", *[F.lit(None).cast("string").alias(c) for c in ("supplier", "raw_description", "profile")], *[F.lit(1).cast("decimal(18,6)").alias(f"dim{i}") for i in (1, 2, 3)])
    shown = json.loads(payload(more).where("offer_id = 1").first().payload)
    assert shown["current_dimensions"] == ["1.000000"] * 3 and shown["supplier"] is None
    assert [r.decision for r in mock_answers(more).orderBy("source_id").collect()] == ["REVIEW", "REVIEW", "KEEP", "KEEP"]


def test_reconcile(spark):
    data = [
        (1, "PROPOSE_CHANGE", ["Конфликт марки: x"], False, []), (2, "PROPOSE_CHANGE", ["Конфликт марки: x"], False, ["grade"]), (3, "KEEP", [], True, []), (4, "keep", [" "], False, ["dim1"]), (5, "review", None, None, []),
    ]
    df = spark.createDataFrame(data, "id int, decision string, warnings array<string>, research_required boolean, changed array<string>")
    once = reconcile(df, F.col("changed"))
    assert {r.id: r.final_decision for r in once.collect()} == {1: "KEEP", 2: "REVIEW", 3: "REVIEW", 4: "PROPOSE_CHANGE", 5: "REVIEW"}
    again = reconcile(once.withColumn("decision", F.col("final_decision")).select(*df.columns), F.col("changed"))
    assert {r.id: r.final_decision for r in again.collect()} == {r.id: r.final_decision for r in once.collect()}


def test_command_line(tmp_path, capsys):
    from sortament.__main__ import main

    assert main(["no"]) == 2 and "COMMAND" in capsys.readouterr().err
