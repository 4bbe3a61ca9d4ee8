"""Lists as people look at them: filters, pages, orders, and names doubled for show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortament.functions.profiles import ROUND_BARS
from sortament.functions.text import profile_key


def filtered(rows: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """``rows`` whose columns have the wanted values; blank and ALL, in any case, want all."""
    asked = {c: v for c, v in wanted.items() if v and v.strip() and v.strip().upper() != "ALL"}
    for column, value in asked.items():
        rows = rows.where(F.col(column) == value.strip())
    return rows


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> tuple[int, DataFrame]:
    """How many rows there are, and ``limit`` of them along ``order`` from ``offset`` on."""
    if offset < 0 or not 1 <= limit <= 1_000:
        raise ValueError("offset is 0 or more and limit 1 to 1000")
    return rows.count(), rows.orderBy(*order).offset(offset).limit(limit)


def candidate_order() -> list[Column]:
    """Rows with source columns first, then by file, whatever the case, and row."""
    return [F.col("source_columns").isNull(), F.lower("source_file"), F.col("source_row")]


def with_lookups(rows: DataFrame, *lookups: tuple[DataFrame, str, list[str]]) -> DataFrame:
    """``rows`` with columns of other tables by their keys (table, key, columns): one join
    each in place of a look-up per row; a row without a match keeps nulls."""
    for table, key, columns in lookups:
        rows = rows.join(table.select(key, *columns).dropDuplicates([key]), key, "left")
    return rows


def answers_to_items(answers: DataFrame, items: DataFrame, answer_key: str, item_key: str, *order: str) -> DataFrame:
    """``answers`` with their item's columns (prefix ``item_``) and ``status``: null, or
    SOURCE_ITEM_NOT_FOUND. Of items with the same key the last by ``order`` counts."""
    rest = [c for c in items.columns if c != item_key]
    last = items.where(F.col(item_key).isNotNull()).groupBy(item_key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_item"))
    joined = answers.join(last.withColumnRenamed(item_key, "_key"), F.col(answer_key) == F.col("_key"), "left")
    missing = F.when(F.col("_key").isNull(), "SOURCE_ITEM_NOT_FOUND")
    return joined.select(*answers.columns, *[F.col(f"_item.{c}").alias(f"item_{c}") for c in rest], missing.alias("status"))


def rows_to_show(items: DataFrame, matched: tuple[str, ...]) -> DataFrame:
    """``items`` of the profiles in ``matched`` (all if it is empty) with ``shown_profile``,
    ``label`` (its place) and ``comment_text``. If the first of ``matched`` names round
    bars, each comes once under each of their names, that one first, and the comment says
    that the other name is no position of its own. No shuffle."""
    key = profile_key(F.col("profile"))
    if not matched or matched[0] not in ROUND_BARS:
        chosen = items.where(key.isin(*matched)) if matched else items
        return chosen.withColumn("shown_profile", F.col("profile")).withColumn("label", F.lit(0))
    labels = [matched[0], *(p for p in ROUND_BARS if p != matched[0])]
    doubled = items.where(key.isin(*ROUND_BARS)).select("*", F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("label", "shown_profile"))
    note = F.concat(F.lit("Поисковый синоним профиля: "), "shown_profile", F.lit("; исходный профиль поставщика: "), "profile", F.lit("; не отдельная складская позиция"))
    comment = F.when(F.col("shown_profile") == key, F.col("comment_text")).otherwise(F.concat_ws("; ", F.when(F.col("comment_text") != "", F.col("comment_text")), note))
    return doubled.withColumn("comment_text", comment)


# The fields of a case and its kinds.
CASE_FIELDS = ("case_id", "case_type", "source_id", "supplier", "description", "current_profile", "current_grade", "current_dimensions", "domain")
CASE_TYPES = ("control", "candidate")


def case_problems(cases: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, problem) of a set of cases and their gold: fields without value, unknown
    types, repeated cases and sources, sizes that aren't three, gold that is repeated, of
    an unknown case or of one that is no control, and controls without gold."""
    blank = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"missing_{c}") for c in CASE_FIELDS if c not in ("case_id", "current_dimensions")]
    own = [*blank, F.when(F.size("current_dimensions") != 3, "dimensions"), F.when(F.col("current_dimensions").isNull(), "missing_current_dimensions"), F.when(~F.col("case_type").isin(*CASE_TYPES), "case_type")]
    found = cases.select("case_id", F.explode(F.array_compact(F.array(*own))).alias("problem"))

    def repeated(df: DataFrame, column: str, problem: str) -> DataFrame:
        counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("c"))
        return counted.where("n > 1").select(F.col("c").alias("case_id"), F.lit(problem).alias("problem"))

    def lacking(df: DataFrame, of: DataFrame, problem: str) -> DataFrame:
        return df.select("case_id").join(of.select("case_id"), "case_id", "left_anti").select("case_id", F.lit(problem).alias("problem")).distinct()

    controls = cases.where("case_type = 'control'")
    parts = [
        repeated(cases, "case_id", "repeated_case"), repeated(cases, "source_id", "repeated_source"), repeated(gold, "case_id", "repeated_gold"), lacking(gold, cases, "gold_of_unknown_case"),
        lacking(gold.join(cases.select("case_id"), "case_id", "left_semi"), controls, "gold_of_no_control"), lacking(controls, gold, "control_without_gold"),
    ]
    for part in parts:
        found = found.unionByName(part)
    return found
