"""Rows for a second look: why, what is shown of them, and what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SURE = 0.9
UNKNOWN_GRADE = "предпол."


def candidate_reasons(reasons: Column, grade: Column, requires_review: Column, confidence: Column) -> Column:
    """The reasons of a row once each, with what its grade adds; rows in review without
    any, and rows that the parser isn't sure of, get a reason of their own."""
    listed = F.array_distinct(F.coalesce(reasons, F.array().cast("array<string>")))
    listed = F.when((grade == UNKNOWN_GRADE) & ~F.array_contains(listed, "unconfirmed_grade"), F.array_append(listed, F.lit("unconfirmed_grade"))).otherwise(listed)
    none = F.size(listed) == 0
    return (
        F.when(none & F.coalesce(requires_review, F.lit(False)), F.array(F.lit("manual_review_required")))
        .when(none & F.coalesce(confidence < LEAST_SURE, F.lit(False)), F.array(F.lit("low_validation_score")))
        .otherwise(listed)
    )


def candidates(offers: DataFrame) -> DataFrame:
    """(offer_id, reasons) of the offers that have a reason."""
    why = candidate_reasons(F.col("review_reasons"), F.col("grade"), F.col("requires_review"), F.col("confidence"))
    return offers.select("offer_id", why.alias("reasons")).where(F.size("reasons") > 0)


def payload(offers: DataFrame) -> DataFrame:
    """(offer_id, payload): what a reviewer or model is shown of an offer, as JSON; no
    field says what the right answer is."""
    shown = F.struct(
        F.col("offer_id").alias("source_id"), "supplier", F.col("raw_description").alias("description"), F.col("profile").alias("current_profile"), F.col("grade").alias("current_grade"),
        F.transform(F.array("dim1", "dim2", "dim3"), lambda d: d.cast("string")).alias("current_dimensions"), "requires_review", "review_reasons",
    )
    return offers.select("offer_id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("payload"))


def mock_answers(offers: DataFrame) -> DataFrame:
    """(source_id, decision, profile, grade): the answers of a provider that keeps what it
    sees and asks for review where the row does."""
    decision = F.when(F.col("requires_review"), "REVIEW").otherwise("KEEP")
    return offers.select(F.col("offer_id").alias("source_id"), decision.alias("decision"), "profile", "grade")


def replayed_answers(payloads: DataFrame, recorded: DataFrame) -> DataFrame:
    """(offer_id, answer): recorded answers (payload_hash, answer) by the SHA-256 of what
    was sent; a payload without record has a null answer."""
    keyed = payloads.select("offer_id", F.sha2("payload", 256).alias("payload_hash"))
    return keyed.join(recorded.dropDuplicates(["payload_hash"]), "payload_hash", "left").select("offer_id", "answer")


def reconcile(results: DataFrame, changed: Column) -> DataFrame:
    """``results`` (decision, warnings, research_required, ...) with ``final_decision`` and
    ``removed_warnings``. Warnings of a grade conflict are false where the grade is not
    among the ``changed`` fields; what is left of warnings, a need of research or a model's
    own REVIEW make it REVIEW, a change PROPOSE_CHANGE, else KEEP. Applying it to its own
    result changes nothing."""
    conflict = F.array_contains(changed, "grade")
    given = F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.trim(w) != "")
    false = F.filter(given, lambda w: ~conflict & F.lower(w).rlike("конфликт марк|grade conflict"))
    left = F.filter(given, lambda w: conflict | ~F.lower(w).rlike("конфликт марк|grade conflict"))
    review = F.coalesce("research_required", F.lit(False)) | (F.size(left) > 0) | (F.upper(F.coalesce("decision", F.lit(""))) == "REVIEW")
    final = F.when(review, "REVIEW").when(F.size(changed) > 0, "PROPOSE_CHANGE").otherwise("KEEP")
    return results.withColumn("final_decision", final).withColumn("removed_warnings", false).withColumn("warnings", left)
