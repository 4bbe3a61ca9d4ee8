"""Importing a report bundle into Parquet tables, any number of times with one result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortament.operators.metrics import table_counts
from sortament.operators.persist import append_once, bundle_hash, stable_id
from sortament.sources.jsonl import canonical_json

TABLES = ("suppliers", "offers", "review_items", "audit_events")


@dataclass(frozen=True)
class Imported:
    """Rows written to each table."""

    job_id: str
    written: dict[str, int]


def import_bundle(spark: SparkSession, folder: str, store: str) -> Imported:
    """Import ``normalized_items.jsonl`` and ``normalization_review_queue.jsonl`` of a folder.

    Ids are deterministic, so a second import writes nothing. A review row must belong to
    an offer of the bundle, and an offer that comes with another content than the store
    has for its id is an error; nothing is written in either case.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select("path", "content")
    job = "job-" + bundle_hash(files)[:24]
    items = spark.read.option("mode", "FAILFAST").json(f"{folder}/normalized_items.jsonl")
    queue = spark.read.option("mode", "FAILFAST").json(f"{folder}/normalization_review_queue.jsonl").select("id")
    if not queue.join(items.select("id"), "id", "left_anti").isEmpty():
        raise ValueError("a review row belongs to no offer")
    name = F.lower(F.trim("supplier"))
    offers = items.withColumn("payload_hash", F.sha2(canonical_json(*items.columns), 256)).withColumn("supplier_id", stable_id("sp", name)).withColumnRenamed("id", "offer_id")
    suppliers = items.select(stable_id("sp", name).alias("supplier_id"), F.trim("supplier").alias("name")).dropDuplicates(["supplier_id"])
    reviews = queue.select(F.col("id").alias("offer_id"), stable_id("rv", F.col("id")).alias("review_id"), F.lit("OPEN").alias("status"))
    audit = spark.createDataFrame([(job, "BUNDLE_IMPORTED")], "event_id string, kind string")
    written = {
        "offers": append_once(spark, f"{store}/offers", offers, "offer_id", "payload_hash"),
        "suppliers": append_once(spark, f"{store}/suppliers", suppliers, "supplier_id"),
        "review_items": append_once(spark, f"{store}/review_items", reviews, "offer_id"),
        "audit_events": append_once(spark, f"{store}/audit_events", audit, "event_id"),
    }
    return Imported(job, written)


def store_counts(spark: SparkSession, store: str) -> DataFrame:
    """(table_name, rows) of the store's tables."""
    return table_counts({t: spark.read.parquet(f"{store}/{t}") for t in TABLES})
