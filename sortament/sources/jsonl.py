"""JSON lines: strict reading, and canonical writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType, *, required: tuple[str, ...] = (), comment: str = "#") -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of a file or folder of JSON lines.

    Blank lines and lines that begin with ``comment`` are left out. ``problems`` is
    (line, reason): no JSON object, a key that the schema lacks, or a required field that
    is missing or null. Nothing is dropped silently: rows and problems make up all lines.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where((F.trim("line") != "") & ~F.ltrim("line").startswith(comment))
    keys = F.json_object_keys("line")
    parsed = lines.withColumn("keys", keys).withColumn("row", F.from_json("line", schema))
    extra = F.size(F.array_except("keys", F.array(*[F.lit(f.name) for f in schema.fields]))) > 0
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(f"row.{name}").isNull()
    reason = F.when(F.col("keys").isNull(), "not_an_object").when(extra, "unknown_field").when(missing, "missing_field")
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason is null").select("row.*"), judged.where("reason is not null").select("line", "reason")


def canonical_json(*columns: str) -> Column:
    """The columns as JSON with sorted keys and nulls written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str) -> None:
    """One canonical JSON object a line; replaces what is there only when all is written."""
    df.select(canonical_json(*df.columns).alias("value")).write.mode("overwrite").text(path)
