"""Writing once: deterministic ids, bundles and appends that may be repeated."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stable_id(prefix: str, value: Column, length: int = 24) -> Column:
    """A deterministic id: prefix and the beginning of the value's SHA-256."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(value, 256), 1, length))


def new_rows(target: DataFrame | None, batch: DataFrame, key: str) -> DataFrame:
    """The rows of ``batch`` that an append writes: each non-null key once, and none that
    the target has."""
    unique = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
    return unique if target is None else unique.join(target.select(key), key, "left_anti")


def conflicting_keys(target: DataFrame, batch: DataFrame, key: str, payload_hash: str) -> DataFrame:
    """(key): keys whose payload differs from what the target has for them."""
    known = target.select(key, F.col(payload_hash).alias("_known"))
    return batch.join(known, key).where(F.col(payload_hash) != F.col("_known")).select(key).distinct()


def append_once(spark: SparkSession, path: str, batch: DataFrame, key: str, payload_hash: str | None = None) -> int:
    """Append the new rows of ``batch`` to the Parquet table at ``path``; the number of
    rows written. Repeating a call writes nothing. Raises if a key comes with another
    payload. Plain Parquet has no transactions: one writer at a time."""
    target = spark.read.parquet(path) if _exists(spark, path) else None
    if target is not None and payload_hash and not conflicting_keys(target, batch, key, payload_hash).isEmpty():
        raise ValueError("a key comes with another payload")
    fresh = new_rows(target, batch, key)
    before = target.count() if target is not None else 0
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def bundle_hash(files: DataFrame) -> str:
    """SHA-256 over files (path, content) in the order of their names. Bundles are a few
    files; their digests, not their contents, come to the driver."""
    digests = files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("digest")).orderBy("name").collect()
    whole = hashlib.sha256()
    for row in digests:
        whole.update(f"{row['name']}\0{row['digest']}".encode())
    return whole.hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def blob_path(folder: str, digest: Column) -> Column:
    """Where a content-addressed store keeps a blob: its rows of two first signs of the digest."""
    return F.concat(F.lit(f"{folder}/part="), F.substring(digest, 1, 2))


def store_blobs(blobs: DataFrame, content: str, folder: str) -> DataFrame:
    """(digest, size, path) of the distinct contents, which the executors write as rows of a
    Parquet table partitioned by the digest's beginning: many small blobs in few files.
    What the store has isn't written again. ``path`` is the part that holds the blob;
    ``read_blobs`` reads it. Null contents are none."""
    spark = blobs.sparkSession
    distinct = blobs.where(F.col(content).isNotNull()).select(F.sha2(F.col(content), 256).alias("digest"), F.col(content).alias("content")).dropDuplicates(["digest"])
    fresh = distinct.withColumn("part", F.substring("digest", 1, 2))
    if _exists(spark, folder):
        fresh = fresh.join(spark.read.parquet(folder).select("digest"), "digest", "left_anti")
    fresh.write.mode("append").partitionBy("part").parquet(folder)
    return distinct.select("digest", F.octet_length("content").cast("long").alias("size"), blob_path(folder, F.col("digest")).alias("path"))


def read_blobs(spark: SparkSession, folder: str, digests: DataFrame) -> DataFrame:
    """(digest, content) of the store's blobs with one of ``digests`` (digest); only the
    parts that may hold them are read."""
    wanted = digests.select("digest", F.substring("digest", 1, 2).alias("part")).distinct()
    store = spark.read.schema("digest string, content binary, part string").parquet(folder)
    return store.join(wanted, ["part", "digest"]).select("digest", "content")
