"""Checking proposed changes against the source before they are applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortament.functions.text import compact_key

FIELDS = ("profile", "material", "grade", "dim1", "dim2", "dim3")
#: What a changed field's best quote gives, from all to none.
CODES = ("CONFIRMED", "VALUE_NOT_STATED", "NOT_IN_SOURCE", "NO_EVIDENCE")
LEAST_CONFIDENCE = 0.80
MOST_CONFIDENCE = 0.95
# Grounds that don't suffice.
WEAK_BASES = ("MODEL_KNOWLEDGE", "INSUFFICIENT")


def _key(name: str, value: Column) -> Column:
    """What of a field's value counts: numbers by value, grades by key, text by letters."""
    text = value.cast("string")
    if name.startswith("dim"):
        return F.coalesce(F.regexp_replace(F.translate(text, ",", ".").try_cast("decimal(18,6)").cast("string"), r"\.?0+$", ""), F.lit(""))
    if name == "grade":
        return F.coalesce(compact_key(text), F.lit(""))
    return F.translate(F.upper(F.trim(F.coalesce(text, F.lit("")))), "Ё", "Е")


def changed_fields(prefix_old: str = "current_", prefix_new: str = "", fields: tuple[str, ...] = FIELDS) -> Column:
    """Names of the fields whose proposed value differs from the current one."""
    tests = [F.when(_key(f, F.col(prefix_old + f)) != _key(f, F.col(prefix_new + f)), F.lit(f)) for f in fields]
    return F.array_compact(F.array(*tests))


def evidence_present(quote: Column, sources: Column) -> Column:
    """The quote isn't blank and stands in one of the source texts, whatever the case."""
    low = F.lower(F.trim(quote))
    return F.coalesce((low != "") & F.exists(sources, lambda s: F.contains(F.lower(s), low)), F.lit(False))


def check_proposals(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """(row_id, changed, confirmed, rejected, codes, decision) of proposals.

    ``proposals``: row_id, the current_ and proposed FIELDS (those it has), sources array<string>,
    confidence, evidence_basis, research_required. ``evidence``: row_id, field, quote. A
    changed field is confirmed if a quote for it stands in the sources and holds the
    proposed value; ``codes`` say of each changed field, as field:code, whether it is
    CONFIRMED or what its best quote lacks (NO_EVIDENCE, NOT_IN_SOURCE,
    VALUE_NOT_STATED). Any rejected field, low confidence, weak basis or need of research
    makes the decision REVIEW; no change KEEP; else PROPOSE_CHANGE.
    """
    fields = tuple(f for f in FIELDS if {f, f"current_{f}"} <= set(proposals.columns))
    rows = proposals.withColumn("changed", changed_fields(fields=fields))
    values = F.create_map(*[x for f in fields for x in (F.lit(f), _key(f, F.col(f)))])
    open_fields = rows.select("row_id", "sources", F.explode("changed").alias("field"), values.alias("values"))
    with_value = open_fields.select("row_id", "sources", "field", F.try_element_at("values", F.col("field")).alias("value"))
    quoted = with_value.join(evidence, ["row_id", "field"], "left")
    holds = F.when(
        F.col("field").startswith("dim"),
        F.array_contains(F.transform(F.regexp_extract_all(F.translate("quote", ",", "."), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: F.regexp_replace(n.try_cast("decimal(18,6)").cast("string"), r"\.?0+$", "")), F.col("value")),
    ).otherwise(F.contains(compact_key(F.col("quote")), compact_key(F.col("value"))))
    ok = evidence_present(F.col("quote"), F.col("sources")) & F.coalesce(holds, F.lit(False)) & (F.col("value") != "")
    stands = evidence_present(F.col("quote"), F.col("sources"))
    lacks = F.when(ok, 0).when(stands, 1).when(F.trim(F.coalesce("quote", F.lit(""))) != "", 2).otherwise(3)
    per_field = quoted.groupBy("row_id", "field").agg(F.max(ok).alias("ok"), F.min(lacks).alias("lacks"))
    code = F.concat_ws(":", "field", F.get(F.array(*[F.lit(c) for c in CODES]), F.col("lacks")))
    per_row = per_field.groupBy("row_id").agg(F.array_sort(F.collect_list(code)).alias("codes"), F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("field")))).alias("confirmed"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("field")))).alias("rejected"))  # at most the FIELDS
    none = F.array().cast("array<string>")
    joined = rows.join(per_row, "row_id", "left").withColumn("confirmed", F.coalesce("confirmed", none)).withColumn("rejected", F.coalesce("rejected", none)).withColumn("codes", F.coalesce("codes", none))
    doubt = (F.size("rejected") > 0) | (F.col("confidence") < LEAST_CONFIDENCE) | F.col("evidence_basis").isin(*WEAK_BASES) | F.col("research_required")
    decision = F.when(F.coalesce(doubt, F.lit(True)), "REVIEW").when(F.size("changed") == 0, "KEEP").otherwise("PROPOSE_CHANGE")
    return joined.select("row_id", "changed", "confirmed", "rejected", "codes", decision.alias("decision"))


def apply_confirmed(items: DataFrame, proposals: DataFrame, checked: DataFrame) -> DataFrame:
    """``items`` (row_id, FIELDS, confidence) with the confirmed fields of proposals whose
    decision is PROPOSE_CHANGE; the confidence rises to at most MOST_CONFIDENCE."""
    use = checked.where("decision = 'PROPOSE_CHANGE'").select("row_id", "confirmed")
    fields = [f for f in FIELDS if f in proposals.columns and f in items.columns]
    new = proposals.select("row_id", *[F.col(f).alias(f"_{f}") for f in fields], F.col("confidence").alias("_confidence")).join(use, "row_id")
    joined = items.join(new, "row_id", "left")
    for f in fields:
        joined = joined.withColumn(f, F.when(F.array_contains("confirmed", f), F.col(f"_{f}").cast(items.schema[f].dataType)).otherwise(F.col(f)))
    raised = F.greatest("confidence", F.least("_confidence", F.lit(MOST_CONFIDENCE)))
    return joined.withColumn("confidence", F.when(F.size("confirmed") > 0, raised).otherwise(F.col("confidence"))).select(*items.columns)


def id_differences(sent: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, problem): ids MISSING from an answer, UNEXPECTED in it, or given DUPLICATE:
    the bag of ids must be the same."""
    a = sent.groupBy(key).agg(F.count(F.lit(1)).alias("sent"))
    b = got.groupBy(key).agg(F.count(F.lit(1)).alias("got"))
    both = a.join(b, key, "full_outer")
    problem = F.when(F.col("got").isNull(), "MISSING").when(F.col("sent").isNull(), "UNEXPECTED").when(F.col("got") != F.col("sent"), "DUPLICATE")
    return both.select(key, problem.alias("problem")).where("problem is not null")
