"""Run metrics, histograms and quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortament.operators.joins import broadcast_if_small
from sortament.session import materialise


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(value, rows) by descending count, then value; nulls count as a value."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), "value")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()])


def offer_stats(offers: DataFrame) -> DataFrame:
    """One row: offers, priced and unpriced, in review, review reasons and suppliers."""
    return offers.agg(
        F.count(F.lit(1)).alias("offers"), F.count("price_rub_kg").alias("priced"), F.count_if(F.col("price_rub_kg").isNull()).alias("unpriced"),
        F.count_if(F.col("requires_review")).alias("in_review"), F.sum(F.coalesce(F.size("review_reasons"), F.lit(0))).cast("long").alias("reasons"),
        F.countDistinct("supplier").alias("suppliers"),
    )


def field_accuracy(results: DataFrame, gold: DataFrame, key: str, fields: tuple[str, ...], equal=None) -> DataFrame:
    """(field, cases, correct, accuracy) over results that have gold; accuracy is rounded
    to four digits and null without cases. Nulls are equal to nulls."""
    equal = equal or (lambda field, a, b: a.eqNullSafe(b))
    pairs = results.select(key, *fields).join(gold.select(key, *[F.col(f).alias(f"_{f}") for f in fields]), key)
    flags = [F.struct(F.lit(f).alias("field"), equal(f, F.col(f), F.col(f"_{f}")).cast("long").alias("ok")) for f in fields]
    long = pairs.select(F.inline(F.array(*flags)))
    counted = long.groupBy("field").agg(F.count(F.lit(1)).alias("cases"), F.sum("ok").alias("correct"))
    return counted.select("field", "cases", "correct", F.round(F.col("correct") / F.col("cases"), 4).alias("accuracy"))


def gate(accuracy: DataFrame, full_row_rate: float, *, least_rows: float = 0.9, least_field: float = 0.95) -> DataFrame:
    """(passed, worst_field): whether all fields and the rate of full rows reach the bar."""
    worst = F.min_by("field", "accuracy")
    passed = F.every(F.col("accuracy") >= least_field) & F.lit(full_row_rate >= least_rows)
    return accuracy.agg(passed.alias("passed"), worst.alias("worst_field"))


def check_status(checks: DataFrame) -> DataFrame:
    """(status): FAILED if a check failed, READY_WITH_LIMITATIONS if one is blocked or not
    verified, else VERIFIED."""
    status = F.col("status")
    return checks.agg(
        F.when(F.bool_or(status == "FAILED"), "FAILED").when(F.bool_or(status.isin("BLOCKED", "NOT_VERIFIED")), "READY_WITH_LIMITATIONS").otherwise("VERIFIED").alias("status")
    )


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, input_tokens, output_tokens, cost) of ``usage`` (model, input_tokens,
    output_tokens) at ``prices`` (model, per_million_in, per_million_out, and ``ordinal``
    if there is one). A price holds for the models whose name begins with its own; of
    several the first by ordinal, else the longest. Without price the cost is null."""
    sums = usage.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    place = F.col("ordinal") if "ordinal" in prices.columns else -F.length("prefix")
    listed = prices.withColumnRenamed("model", "prefix").withColumn("_place", place)
    # Prices are a few rows and models as many as there are names.
    met = sums.select("model").join(broadcast_if_small(listed, 10_000), F.col("model").startswith(F.col("prefix")))
    best = met.groupBy("model").agg(F.min_by(F.struct("per_million_in", "per_million_out"), F.struct("_place", "prefix")).alias("p"))
    cost = (F.col("input_tokens") * F.col("p.per_million_in") + F.col("output_tokens") * F.col("p.per_million_out")) / 1e6
    return sums.join(best, "model", "left").select("model", "input_tokens", "output_tokens", F.round(cost, 6).alias("cost"))


def search_stats(hits: DataFrame, exact: str) -> DataFrame:
    """One row over the hits of a search: all, exact and nearest ones, those with a price
    and without, and the suppliers in order."""
    of = F.col("match_type") == exact
    return hits.agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(of).alias("exact"), F.count_if(~of).alias("nearest"), F.count("price_rub_kg").alias("priced"),
        F.count_if(F.col("price_rub_kg").isNull()).alias("unpriced"), F.array_sort(F.collect_set("supplier")).alias("suppliers"),
    )


def in_order(rows: DataFrame, group: str, value: str, *order: str) -> DataFrame:
    """(group, in_order): whether ``value`` never falls along ``order``; steps from or to a
    null count as right. A group's rows are sorted in one task, which spills."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    return rows.select(group, step.alias("_step")).groupBy(group).agg(F.every(F.coalesce(F.col("_step") >= 0, F.lit(True))).alias("in_order"))


def row_accuracy(results: DataFrame, gold: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(cases, full_rows, full_row_rate, unneeded_reviews, unneeded_review_rate) of results
    that have gold: rows with all fields right, and rows in review (``requires_review``)
    that need none by the gold. Rates have four digits and are null without cases."""
    pairs = results.select(key, "requires_review", *fields).join(gold.select(key, F.col("requires_review").alias("_r"), *[F.col(f).alias(f"_{f}") for f in fields]), key)
    right = reduce(Column.__and__, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields], F.lit(True))
    unneeded = F.coalesce(F.col("requires_review") & ~F.col("_r"), F.lit(False))
    sums = pairs.agg(F.count(F.lit(1)).alias("cases"), F.count_if(right).alias("full_rows"), F.count_if(unneeded).alias("unneeded_reviews"))
    rate = lambda c: F.round(F.col(c) / F.nullif("cases", F.lit(0)), 4)
    return sums.select("cases", "full_rows", rate("full_rows").alias("full_row_rate"), "unneeded_reviews", rate("unneeded_reviews").alias("unneeded_review_rate"))


def reconciliation_summary(reconciled: DataFrame) -> DataFrame:
    """One row over reconciled results (decision, final_decision, removed_warnings,
    warnings): rows, decisions that changed, warnings removed and left, and the rate of
    rows whose decision was consistent from the start (four digits, null without rows)."""
    same = F.coalesce(F.upper("decision") == F.col("final_decision"), F.lit(False))
    size = lambda c: F.coalesce(F.sum(F.size(F.coalesce(c, F.array().cast("array<string>")))), F.lit(0)).cast("long")
    sums = reconciled.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("changed"), size("removed_warnings").alias("removed"), size("warnings").alias("left"), F.count_if(same).alias("_same"))
    return sums.select("rows", "changed", "removed", "left", F.round(F.col("_same") / F.nullif("rows", F.lit(0)), 4).alias("consistency_rate"))


def batch_manifest(batches: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """(batch, rows, answered, complete) of ``batches`` (key, batch): how many rows of each
    batch have an answer, and whether all have."""
    done = answers.select(key, F.lit(1).alias("_done")).distinct()
    counted = batches.join(done, key, "left").groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.count("_done").alias("answered"))
    return counted.withColumn("complete", F.col("rows") == F.col("answered"))


def positional_ids(rows: DataFrame, prefix: str, width: int, *order: str) -> DataFrame:
    """``rows`` with ``id``: the prefix and the row's place along ``order``, from 1, with
    leading zeros. Places come from counts of range partitions."""
    place = (F.col("batch") + 1).cast("string")
    numbered = in_batches(rows, 1, *order)
    return numbered.withColumn("id", F.concat(F.lit(f"{prefix}-"), F.when(F.length(place) < width, F.lpad(place, width, "0")).otherwise(place))).drop("batch")


def in_batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """``rows`` with ``batch``, ordered chunks of ``size``. Positions come from the counts
    of range partitions, not from one window over everything."""
    ordered = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    counts = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("_least"))  # one row a partition
    before = counts.alias("a").join(counts.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy("a._p", "a._least").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    numbered = ordered.join(F.broadcast(before), "_p")
    return numbered.withColumn("batch", F.floor((F.col("before") + F.col("_m") - F.col("_least")) / size).cast("long")).drop("_p", "_m", "_least", "before")

