"""Loading delimited lines: valid rows apart from rows that fail, each with its reason.

Lines are cut into cells, the cells exploded to (row, column, value), a small rule
table joined on the column, every rule evaluated, errors reduced to the first reason
of a row and the clean rows taken by an anti-join with the rows that failed.

Only failing cells are shuffled: the rules are evaluated before the reduction and
valid cells drop out on the map side, so the shuffle is of the size of the errors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

FIELDS = ("supplier", "description", "availability", "price", "grade_hint", "price_date")

# Reasons, in the order in which the first one applies.
REASONS = ("broken_quoting", "column_count", "invalid_value")

_ESC = "\ufdd0"  # a noncharacter; protects itself and the delimiter inside quotes


@dataclass(frozen=True)
class Rule:
    """One requirement on one column. ``kind``: 'has_letter', 'price' or 'date'."""

    column: int
    kind: str


PRICE_LIST_RULES = (Rule(1, "has_letter"), Rule(1, "well_decoded"), Rule(3, "price"), Rule(5, "date"))


def _outside_ok(segments: Column, count: Column) -> Column:
    """The text between quoted fields: what stands outside quotes starts and ends with
    the delimiter wherever it touches a quote, and holds no line break."""

    def fine(s: Column, i: Column) -> Column:
        inner = (i % 2) == 1
        first, last = i == 0, i == count - 1
        left = first | (s == "") | s.startswith(";")
        right = last | (s == "") | s.endswith(";")
        return inner | (left & right & ~s.rlike("[\r\n]"))

    return F.forall(F.transform(segments, fine), lambda x: x)


def split_line(line: Column) -> Column:
    """struct<ok boolean, cells array<string>> of a line of fields separated by ``;``.

    A field that holds ``;``, ``"`` or a line break stands in ``"`` with inner ``"``
    doubled; any field may. ``ok`` is false where the line can't be split that way.
    Null is one empty field. Linear in the length of the line; no recursion, so long
    lines are safe.
    """
    text = F.coalesce(line, F.lit(""))
    segments = F.split(text, '"')
    count = F.size(segments)
    ok = ((count % 2) == 1) & _outside_ok(segments, count)

    def rebuilt(s: Column, i: Column) -> Column:
        safe = F.replace(s, F.lit(_ESC), F.lit(_ESC + "a"))
        inner = (i % 2) == 1
        doubled = (s == "") & (i > 0) & (i < count - 1)
        return F.when(inner, F.replace(safe, F.lit(";"), F.lit(_ESC + "b"))).when(doubled, F.lit('"')).otherwise(safe)

    joined = F.array_join(F.transform(segments, rebuilt), "")
    cells = F.transform(
        F.split(joined, ";"),
        lambda c: F.replace(F.replace(c, F.lit(_ESC + "b"), F.lit(";")), F.lit(_ESC + "a"), F.lit(_ESC)),
    )
    return F.struct(ok.alias("ok"), cells.alias("cells"))


def price_value(text: Column) -> Column:
    """A price as decimal(18,4); null if it isn't a number as price lists write it:
    digits with ordinary or no-break spaces or ``'`` among them, at most one decimal
    sign with one to four digits after it, and руб, руб., р. or ₽ at the end."""
    bare = F.regexp_replace(text, r"[\s\u00a0\u202f]*(?:руб\.?|р\.|₽)?[\s\u00a0\u202f]*$", "")
    bare = F.regexp_replace(bare, r"[ \u00a0\u202f']", "")
    return F.when(bare.rlike(r"^[0-9]+(?:[.,][0-9]{1,4})?$"), F.translate(bare, ",", ".")).try_cast("decimal(18,4)")


def date_value(text: Column) -> Column:
    """A date written as dd.mm.yyyy or yyyy-mm-dd; null if it is no real day."""
    bare = F.trim(text)
    iso = F.when(bare.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), bare).when(
        bare.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"),
        F.concat_ws("-", F.substring(bare, 7, 4), F.substring(bare, 4, 2), F.substring(bare, 1, 2)),
    )
    return F.when(~iso.startswith("0000"), iso).try_cast("date")


def _blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s]")


def _passes(kind: Column, value: Column) -> Column:
    price = price_value(value)
    return (
        F.when(kind == "has_letter", value.rlike(r"\p{L}"))
        .when(kind == "well_decoded", ~value.contains("\ufffd"))
        .when(kind == "price", _blank(value) | F.coalesce((price > 0) & (price < 10_000_000), F.lit(False)))
        .when(kind == "date", _blank(value) | date_value(value).isNotNull())
        .otherwise(F.lit(True))
    )


@dataclass(frozen=True)
class LoadResult:
    """``loaded``: one row per valid line with FIELDS as columns, price and date typed.
    ``rejected``: (key, reason), one row per key that failed."""

    loaded: DataFrame
    rejected: DataFrame


def load_lines(
    lines: DataFrame, key: str, text: str, *, fields: tuple[str, ...] = FIELDS, rules: tuple[Rule, ...] = PRICE_LIST_RULES
) -> LoadResult:
    """Split ``text`` into ``fields`` and set rows apart that fail.

    Nulls: a null line has one empty field and fails on its number of columns. A null
    key is kept as a row of its own reason but can't be told from other null keys.
    Repeated rows: a key that comes more than once is rejected if any of its lines
    fails. Other columns of ``lines`` are ignored, so their names can't clash. Empty
    input gives empty results.
    """
    spark = lines.sparkSession
    parsed = lines.select(F.col(key).alias("key"), split_line(F.col(text)).alias("line"))
    cut = parsed.select("key", F.col("line.ok").alias("ok"), F.col("line.cells").alias("cells"))
    shape = F.when(~F.col("ok"), F.lit(0)).when(F.size("cells") != len(fields), F.lit(1))
    rule_rows = spark.createDataFrame(
        [(r.column, r.kind) for r in rules],
        StructType([StructField("column", IntegerType()), StructField("kind", StringType())]),
    )
    misshapen = cut.select("key", shape.alias("rank")).where("rank is not null")
    cells = cut.where(shape.isNull()).select("key", F.posexplode("cells").alias("column", "value"))
    invalid = (
        cells.join(F.broadcast(rule_rows), "column")  # as many rows as there are rules
        .where(~_passes(F.col("kind"), F.col("value")))
        .select("key", F.lit(2).alias("rank"))
    )
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("rank") + 1)
    errors = misshapen.unionByName(invalid).groupBy("key").agg(F.min("rank").alias("rank"))
    rejected = errors.select("key", reason.alias("reason"))
    named = cut.where(shape.isNull()).select("key", *[F.col("cells")[i].alias(f) for i, f in enumerate(fields)])
    if "price" in fields:
        named = named.withColumn("price", price_value(F.col("price")))
    if "price_date" in fields:
        named = named.withColumn("price_date", date_value(F.col("price_date")))
    loaded = named.join(rejected.select("key"), "key", "left_anti")
    return LoadResult(loaded.withColumnRenamed("key", key), rejected.withColumnRenamed("key", key))


def reject_counts(lines: DataFrame, rejected: DataFrame, key: str, file: str) -> DataFrame:
    """Per file: lines, loaded and skipped lines by reason; what a loader's own count of
    skipped rows is replaced by."""
    seen = lines.select(F.col(key).alias(key), F.col(file).alias(file)).join(rejected, key, "left")
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    return seen.groupBy(file).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("reason").isNull()).alias("loaded"), F.count("reason").alias("skipped_rows"), *counts
    )
