"""Totals and versions of commercial documents, in decimals rounded half up at each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(value: Column) -> Column:
    """Rounded half up to two digits, decimal(18,2)."""
    return F.round(value, 2).cast(MONEY)


def document_totals(lines: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """(key, subtotal, base, vat, total).

    ``lines``: key, quantity decimal, unit_price decimal, markup_rate decimal. ``heads``:
    key, discount, delivery, vat_rate decimals, prices_include_vat boolean. The base is
    the subtotal less discount plus delivery; VAT is part of it or on top. A document
    without lines has a subtotal of 0; lines without head are left out.
    """
    price = money(F.col("unit_price") * (1 + F.col("markup_rate") / F.lit(100).cast("decimal(3,0)")))
    priced = lines.select(key, money(F.col("quantity") * price).alias("amount"))
    sums = priced.groupBy(key).agg(F.sum("amount").cast(MONEY).alias("subtotal"))
    joined = heads.join(sums, key, "left").withColumn("subtotal", F.coalesce("subtotal", F.lit(0).cast(MONEY)))
    base = money(F.col("subtotal") - F.col("discount") + F.col("delivery"))
    joined = joined.withColumn("base", base)
    rate = F.col("vat_rate")
    hundred = F.lit(100).cast("decimal(3,0)")
    vat = F.when(F.col("prices_include_vat"), money(F.col("base") * rate / (hundred + rate))).otherwise(money(F.col("base") * rate / hundred))
    joined = joined.withColumn("vat", vat)
    total = F.when(F.col("prices_include_vat"), F.col("base")).otherwise(money(F.col("base") + F.col("vat")))
    return joined.select(key, "subtotal", "base", "vat", total.alias("total"))


def next_versions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(document_key, content_hash, version) of ``new`` (document_key, content_hash): the
    version that a document with the same content already has, else one more than the
    greatest of its key. Several new contents of a key are numbered by their hash."""
    known = existing.select("document_key", "content_hash", F.col("version").alias("_v")).dropDuplicates(["document_key", "content_hash"])
    top = existing.groupBy("document_key").agg(F.max("version").alias("_top"))
    joined = new.select("document_key", "content_hash").distinct().join(known, ["document_key", "content_hash"], "left").join(top, "document_key", "left")
    fresh = joined.where("_v is null")
    order = Window.partitionBy("document_key").orderBy("content_hash")
    numbered = fresh.withColumn("_v", (F.coalesce("_top", F.lit(0)) + F.row_number().over(order)).cast("long"))
    return joined.where("_v is not null").unionByName(numbered).select("document_key", "content_hash", F.col("_v").cast("long").alias("version"))
