"""Raw items to normalised rows: what the description states, amounts, prices, doubts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortament.functions.dimensions import parse_price, parser_confidence
from sortament.functions.extract import read_product
from sortament.functions.profiles import domain_of, material_of, profile_of, search_profiles
from sortament.functions.text import compact_key, squeeze_space
from sortament.operators.units import stated_amount
from sortament.session import ship_package

UNKNOWN_GRADE = "предпол."
# Profiles that have no sizes.
SIZELESS = ("ЛОМ", "ШИХТА")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [read_product(t) if t else (None, None, []) for t in batch.column("description").to_pylist()]
        columns = [pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "designation", "sizes"])


def parse_items(items: DataFrame, key: str = "item_id") -> DataFrame:
    """One normalised row per raw item.

    The grade is the hint if there is one, else what the description states, else
    ``предпол.``; a hint that the description contradicts is a ``grade_conflict``. Sizes are
    millimetres. A null description is an unparsed one. Nothing is dropped.
    """
    ship_package(items.sparkSession)
    chosen = items.select(key, "supplier", "description", "availability", "price", "grade_hint", F.get_json_object("extra_json", "$.availability_unit").alias("outer_unit"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields) + ", designation string, sizes array<bigint>"
    read = chosen.mapInArrow(_read, schema)
    hint = F.when(F.trim("grade_hint") != "", F.trim("grade_hint"))
    named = F.coalesce(hint, F.upper("designation"), F.lit(UNKNOWN_GRADE))
    conflict = hint.isNotNull() & F.col("designation").isNotNull() & (compact_key(hint) != compact_key(F.col("designation")))
    size = [F.round(F.get("sizes", F.lit(i)) / 1000, 6).cast("decimal(18,6)").alias(f"dim{i + 1}") for i in range(3)]
    amount = stated_amount(F.col("availability"), F.col("outer_unit"))
    rows = read.select(
        key, squeeze_space(F.col("supplier")).alias("supplier"), F.col("description").alias("raw_description"), profile_of(F.col("description")).alias("profile"),
        named.alias("grade"), compact_key(named).alias("grade_key"), *size, material_of(F.col("description")).alias("material"),
        amount["amount"].alias("quantity_value"), amount["unit"].alias("quantity_unit"), parse_price(F.col("price")).alias("price_rub_kg"), conflict.alias("conflict"),
    )
    sizeless = F.col("profile").isin(*SIZELESS)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("profile") == "НЕ ОПРЕДЕЛЁН", "profile_unparsed"), F.when(F.col("conflict"), "grade_conflict"),
            F.when(F.col("grade") == UNKNOWN_GRADE, "unconfirmed_grade"), F.when(F.col("dim1").isNull() & ~sizeless, "dimension_unparsed"),
        )
    )
    rows = rows.withColumn("review_reasons", reasons).withColumn("requires_review", F.size("review_reasons") > 0)
    none = F.lit(False)
    confidence = parser_confidence(grade_unknown=F.col("grade") == UNKNOWN_GRADE, sizes_unknown=F.col("dim1").isNull() & ~sizeless, conflict=F.col("conflict"), unverified=none, pending=none, warnings=F.lit(0))
    rows = rows.withColumn("confidence", confidence).withColumn("domain", domain_of(F.col("raw_description"), F.col("profile")))
    return rows.withColumn("accepted_profiles", search_profiles(F.col("profile"))).drop("conflict")
