"""Records that are the same but for how they are written: one each, with its copies.

Every record gets a canonical form of all compared columns. Records are range-partitioned
by the form's hash and their id and sorted outside memory by Spark; each partition is
scanned once and adjacent records compared by their full form. As the id takes part in
the ranges, a form with a third of all records is spread over many partitions; only runs
with the first or the last hash of a partition can go on in another, so merging runs
concerns two rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortament.functions.text import bag_key
from sortament.operators.joins import broadcast_if_small
from sortament.session import materialise, ship_package

_SCHEMA = "id bigint, first bigint, copies bigint, run bigint, form string"
_NAMES = ["id", "first", "copies", "run", "form"]


def canonical_form(exact: list[str], texts: list[str]) -> Column:
    """All compared columns in one string: exact values as they are, texts as bags of
    words. Null if an exact value is null; a null text has no words, like an empty one."""
    parts = [F.col(c).cast("string") for c in exact] + [bag_key(F.col(c)) for c in texts]
    return F.concat(*[F.concat(p, F.lit("\u0001")) for p in parts])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal forms in a sorted partition. Rows of runs inside the partition come
    out finished if the run has two or more. Runs with the first or the last hash of the
    partition may go on in another: their rows come out with a null ``copies``, and each
    such run once more as (null id, first, its length, run, form). Kept at once: a batch,
    and eight bytes for each row of the hash that is open."""
    held: dict[str, list[np.ndarray]] = {}  # ids of the open hash's runs, by form
    open_hash = first_hash = None
    edges = 0
    partition = TaskContext.get().partitionId()

    def rows(ids: np.ndarray, first: np.ndarray, copies: np.ndarray | None, run: int | None = None) -> pa.RecordBatch:
        n = len(ids)
        counts = pa.array(copies, pa.int64()) if copies is not None else pa.nulls(n, pa.int64())
        runs = pa.array(np.full(n, run), pa.int64()) if run is not None else pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first, pa.int64()), counts, runs, pa.nulls(n, pa.string())], _NAMES)

    def close(edge: bool) -> Iterator[pa.RecordBatch]:
        nonlocal edges
        for form, parts in held.items():
            ids = np.concatenate(parts)
            if edge:
                run = (partition << 24) + edges
                edges += 1
                yield rows(ids, np.full(len(ids), ids[0]), None, run)
                one = [pa.nulls(1, pa.int64()), *(pa.array([x], pa.int64()) for x in (ids[0], len(ids), run)), pa.array([form], pa.string())]
                yield pa.RecordBatch.from_arrays(one, _NAMES)
            elif len(ids) > 1:
                yield rows(ids, np.full(len(ids), ids[0]), np.full(len(ids), len(ids)))
        held.clear()

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, hashes, forms = batch.column("id").to_numpy(), batch.column("hash").to_numpy(), batch.column("form")
        if first_hash is None:
            open_hash = first_hash = hashes[0]
        new = np.concatenate([[True], pc.not_equal(forms.slice(1), forms.slice(0, n - 1)).to_numpy(zero_copy_only=False)])
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], n)
        before = np.searchsorted(hashes[starts], open_hash, "right")  # runs that go on with the open hash
        for k in range(before):
            held.setdefault(forms[int(starts[k])].as_py(), []).append(ids[starts[k] : stops[k]])
        if before == len(starts):
            continue
        yield from close(open_hash == first_hash)
        open_hash = hashes[-1]
        after = np.searchsorted(hashes[starts], open_hash, "left")  # runs of the hash that stays open
        length = (stops - starts)[before:after]
        many = length > 1
        if many.any():
            begin, length = starts[before:after][many], length[many]
            count = np.repeat(length, length)
            at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
            yield rows(ids[at], np.repeat(ids[begin], length), count)
        for k in range(after, len(starts)):
            held.setdefault(forms[int(starts[k])].as_py(), []).append(ids[starts[k] : stops[k]])
    yield from close(True)


def duplicate_sets(records: DataFrame, id_column: str, *, exact: list[str], texts: list[str]) -> DataFrame:
    """(id, first, copies): one row per record in a set of two or more; ``first`` is the
    smallest id of its set and ``copies`` the size of the set.

    ``id_column`` must be an integer. Records with a null id or a null in ``exact`` are
    in no set; a null text is like an empty one. The same id given twice counts twice.
    Other columns are not read. Empty input gives no rows.
    """
    forms = records.select(F.col(id_column).cast("long").alias("id"), canonical_form(exact, texts).alias("form"))
    forms = forms.where("id is not null and form is not null")
    ship_package(records.sparkSession)
    # Written, as Spark reads what it sorts twice: ranges come from a sample, of 16 bytes a row.
    hashed = materialise(forms.withColumn("hash", F.xxhash64("form")))
    ordered = hashed.repartitionByRange("hash", "id").sortWithinPartitions("hash", "form", "id")
    scanned = materialise(ordered.mapInArrow(_scan, _SCHEMA))
    # Two rows a partition, unless hashes collide there; forms, which may be long, are joined
    # by a shuffle and only the runs' numbers go to all tasks.
    edges = materialise(scanned.where("id is null").select("first", "copies", "run", "form"))
    merged = edges.groupBy("form").agg(F.min("first").alias("whole"), F.sum("copies").alias("total"))
    of_run = edges.hint("merge").join(merged, "form").where("total > 1").select("run", "whole", "total")
    rows = scanned.where("id is not null")
    open_rows = rows.where("copies is null").join(broadcast_if_small(of_run), "run")
    return rows.where("copies is not null").select("id", "first", "copies").unionByName(
        open_rows.select("id", F.col("whole").alias("first"), F.col("total").alias("copies"))
    )


def collapse(records: DataFrame, id_column: str, *, exact: list[str], texts: list[str]) -> DataFrame:
    """``records`` with one representative (the smallest id) per set and ``copies``.
    Records in no set stay, with 1."""
    sets = duplicate_sets(records, id_column, exact=exact, texts=texts)
    members = sets.select(F.col("id").alias(id_column), F.col("first").alias("_first"), F.col("copies").alias("_copies")).distinct()
    joined = records.join(members, id_column, "left").where(F.col("_first").isNull() | (F.col("_first") == F.col(id_column)))
    return joined.withColumn("copies", F.coalesce("_copies", F.lit(1).cast("long"))).drop("_first", "_copies")


def offer_duplicates(offers: DataFrame) -> DataFrame:
    """(offer_id, first_offer_id, copies) of offers equal but for writing."""
    sets = duplicate_sets(offers, "offer_id", exact=["price_rub_kg"], texts=["raw_description", "supplier"])
    return sets.select(F.col("id").alias("offer_id"), F.col("first").alias("first_offer_id"), "copies")
