"""An append-only log of decisions, and applying it to the rows they concern."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``; one aggregation with map-side combine, so a
    key with a third of the log sends one row from each task."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def with_previous(log: DataFrame, key: str, id_column: str, *order: str) -> DataFrame:
    """``log`` with ``previous_id``: the decision before each within its key."""
    return log.withColumn("previous_id", F.lag(id_column).over(Window.partitionBy(key).orderBy(*order)))


def queue_states(queue: DataFrame, log: DataFrame, key: str, action: str, *order: str) -> DataFrame:
    """``queue`` with ``state``: RESOLVED, DEFERRED or UNRESOLVED by its latest decision."""
    newest = latest(log, key, *order).select(key, F.col(action).alias("_a"))
    state = F.when(F.col("_a").isNull(), "UNRESOLVED").when(F.col("_a") == "DEFER", "DEFERRED").otherwise("RESOLVED")
    return queue.join(newest, key, "left").withColumn("state", state).drop("_a")


# Reasons that put a row into the queue of conflicting rows.
CONFLICTS = ("business_rule_pending", "grade_conflict")


def review_queues(items: DataFrame) -> DataFrame:
    """``items`` in review, with ``normalisation`` (a reason of CONFLICTS; null where there
    are no reasons at all) and ``any_reason``: two queues that may share rows."""
    conflict = F.exists("review_reasons", lambda r: r.isin(*CONFLICTS))
    return items.where("requires_review").withColumn("normalisation", conflict).withColumn("any_reason", F.coalesce(F.size("review_reasons"), F.lit(0)) > 0)


def state_counts(states: DataFrame) -> DataFrame:
    """Counts of a queue; a deferred row counts as unresolved."""
    return states.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "RESOLVED").alias("resolved"), F.count_if(F.col("state") == "DEFERRED").alias("deferred"),
        F.count_if(F.col("state") != "RESOLVED").alias("unresolved"),
    )


def fingerprint(*columns: str):
    """SHA-256 of the columns as JSON with sorted keys and nulls written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def apply_latest(items: DataFrame, log: DataFrame, key: str, changes: tuple[str, ...], *order: str, clear: bool = False) -> DataFrame:
    """``items`` with the non-null ``changes`` of their latest decision where it is
    CONFIRMED and its ``source_fingerprint`` is the item's; ``apply_status`` is APPLIED,
    SKIPPED_SOURCE_MISMATCH or null. Reasons that the decision resolved leave
    ``review_reasons``, whose other repetitions stay; with ``clear`` all reasons go, as a
    store does whose decisions settle a row."""
    newest = latest(log, key, *order)
    renamed = newest.select(key, *[F.col(c).alias(f"_{c}") for c in newest.columns if c != key])
    joined = items.join(renamed, key, "left")
    confirmed = F.col("_decision_status") == "CONFIRMED"
    same = F.col("_source_fingerprint") == F.col("source_fingerprint")
    status = F.when(confirmed & same, "APPLIED").when(confirmed, "SKIPPED_SOURCE_MISMATCH")
    joined = joined.withColumn("apply_status", status)
    done = F.col("apply_status") == "APPLIED"
    for c in changes:
        joined = joined.withColumn(c, F.when(done, F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    left = F.filter("review_reasons", lambda r: ~F.array_contains(F.coalesce("_resolved_review_reasons", F.array().cast("array<string>")), r))
    if clear:
        left = F.array().cast("array<string>")
    joined = joined.withColumn("review_reasons", F.when(done, left).otherwise(F.col("review_reasons")))
    joined = joined.withColumn("requires_review", F.when(done, F.size("review_reasons") > 0).otherwise(F.col("requires_review")))
    return joined.select(*items.columns, "apply_status")


def invalid_decisions(log: DataFrame, numbers: tuple[str, ...], texts: tuple[str, ...]) -> DataFrame:
    """(decision_id, problem): decisions without operator or comment, of an unknown action,
    updates without rule, changes of numbers that aren't above 0 and of texts to blanks."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    problems = [
        F.when(blank("operator"), "operator"), F.when(blank("comment"), "comment"), F.when(~F.coalesce(F.col("action").isin("KEEP", "UPDATE", "DEFER"), F.lit(False)), "action"),
        F.when((F.col("action") == "UPDATE") & (blank("rule_id") | blank("rule_version")), "rule"),
        *[F.when(F.col(c).isNotNull() & ~F.coalesce(F.translate(F.col(c).cast("string"), ",", ".").try_cast("decimal(18,6)") > 0, F.lit(False)), c) for c in numbers],
        *[F.when(F.col(c).isNotNull() & blank(c), c) for c in texts],
    ]
    return log.select("decision_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def unmatched_decisions(log: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Decisions on rows that don't exist."""
    return log.join(items.select(key).distinct(), key, "left_anti")


def append_new(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` whose key the log lacks, each key once: what an idempotent
    append writes. A null key is always new."""
    keyed = new.where(F.col(key).isNotNull()).dropDuplicates([key])
    return keyed.join(log.select(key), key, "left_anti").unionByName(new.where(F.col(key).isNull()))
