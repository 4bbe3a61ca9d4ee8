"""Catalogue and inventory files as DataFrames, checked while they are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructField, StructType

from sortament.functions.dimensions import size_list
from sortament.operators.catalog import catalog_violations
from sortament.sources.jsonl import read_jsonl


def _schema(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


_TEXT = StringType()
GRADES = _schema(id=_TEXT, canonical=_TEXT, status=_TEXT, source_reference=_TEXT, standard_system=_TEXT)
ALIASES = _schema(id=_TEXT, alias=_TEXT, canonical_grade_id=_TEXT, status=_TEXT, source_reference=_TEXT)
RELATIONS = _schema(id=_TEXT, source_grade_id=_TEXT, target_grade_id=_TEXT, relation_type=_TEXT, status=_TEXT, source_reference=_TEXT, bidirectional=BooleanType())
INVENTORY = _schema(id=_TEXT, supplier=_TEXT, profile=_TEXT, grade=_TEXT, dimensions=ArrayType(_TEXT), source_reference=_TEXT, payload=MapType(_TEXT, _TEXT), dimension_units=ArrayType(_TEXT))


class BadFile(ValueError):
    """A file breaks its format; the message shows the first problems."""


@dataclass(frozen=True)
class Catalog:
    grades: DataFrame
    aliases: DataFrame
    relations: DataFrame


def _strict(spark: SparkSession, path: str, schema: StructType, required: tuple[str, ...]) -> DataFrame:
    rows, problems = read_jsonl(spark, path, schema, required=required)
    first = problems.limit(3).collect()
    if first:
        raise BadFile(f"{path}: " + "; ".join(f"{r['reason']}: {r['line'][:80]}" for r in first))
    return rows


def read_catalog(spark: SparkSession, folder: str) -> Catalog:
    """The catalogue of a folder; raises BadFile for lines or references that don't hold."""
    grades = _strict(spark, f"{folder}/grades.jsonl", GRADES, ("id", "canonical", "status")).withColumnRenamed("id", "grade_id")
    aliases = _strict(spark, f"{folder}/aliases.jsonl", ALIASES, ("id", "alias", "canonical_grade_id", "status")).withColumnRenamed("id", "alias_id")
    relations = _strict(spark, f"{folder}/equivalences.jsonl", RELATIONS, ("id", "source_grade_id", "target_grade_id")).withColumnRenamed("id", "equivalence_id")
    bad = catalog_violations(grades, aliases, relations).limit(3).collect()
    if bad:
        raise BadFile(f"{folder}: " + "; ".join(f"{r['check']}: {r['subject']}" for r in bad))
    return Catalog(grades, aliases, relations)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(offer_id, supplier, profile, grade, dim1, dim2, dim3, dim1_unit, source_reference,
    payload) of an inventory; ids must be unique."""
    rows = _strict(spark, path, INVENTORY, ("id", "supplier", "profile", "grade", "source_reference"))
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise BadFile(f"{path}: the id {twice[0]['id']} comes twice")
    sizes = [F.get(size_list(F.coalesce(F.get("dimensions", F.lit(i)), F.lit(""))), F.lit(0)).alias(f"dim{i + 1}") for i in range(3)]
    return rows.select(F.col("id").alias("offer_id"), "supplier", "profile", "grade", *sizes, F.get("dimension_units", F.lit(0)).alias("dim1_unit"), "source_reference", "payload")
