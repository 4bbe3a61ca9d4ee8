"""The reference catalogue: integrity checks, and resolving names and relations.

Catalogue tables are small reference data. They are broadcast only after their size has
been checked; otherwise the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sortament.functions.text import grade_match_key, profile_key
from sortament.operators.joins import broadcast_if_small


def catalog_violations(grades: DataFrame, aliases: DataFrame, relations: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """(check, subject): blank or repeated ids, repeated canonical keys, confirmed records
    without source, aliases without grade, alias keys that are another grade's canonical
    key or belong to several grades, relations to unknown grades or to itself, negative
    tolerances and profiles with several confirmed rules.

    ``rules``: (rule_id, profile, tolerance1, tolerance2, tolerance3, status,
    source_reference); a null tolerance is none."""

    def rows(check: str, df: DataFrame, subject: str) -> DataFrame:
        return df.select(F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject")).distinct()

    def repeated(check: str, df: DataFrame, column) -> DataFrame:
        return rows(check, df.groupBy(column.alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and s is not null"), "s")

    canonical = grades.select("grade_id", grade_match_key(F.col("canonical")).alias("key"))
    named = aliases.select("alias_id", "canonical_grade_id", grade_match_key(F.col("alias")).alias("key"))
    found = [
        repeated("repeated_grade_id", grades, F.col("grade_id")),
        repeated("repeated_alias_id", aliases, F.col("alias_id")),
        repeated("repeated_canonical_key", canonical, F.col("key")),
        rows("blank_alias_id", aliases.where("trim(coalesce(alias_id, '')) = ''"), "alias"),
        rows("blank_id", grades.where("trim(coalesce(grade_id, '')) = ''"), "canonical"),
        rows("confirmed_without_source", grades.where("status = 'CONFIRMED' and trim(coalesce(source_reference, '')) = ''"), "grade_id"),
        rows("alias_without_grade", aliases.join(grades, aliases["canonical_grade_id"] == grades["grade_id"], "left_anti"), "alias_id"),
        rows("alias_is_other_canonical", named.join(canonical, "key").where("canonical_grade_id <> grade_id"), "alias_id"),
        rows("alias_of_several_grades", named.groupBy("key").agg(F.countDistinct("canonical_grade_id").alias("n")).where("n > 1"), "key"),
    ]
    if relations is not None:
        found.append(rows("blank_relation_id", relations.where("equivalence_id is null"), "source_grade_id"))
        found.append(repeated("repeated_relation_id", relations, F.col("equivalence_id")))
        ends = relations.select("equivalence_id", F.explode(F.array("source_grade_id", "target_grade_id")).alias("grade_id"))
        found.append(rows("relation_to_unknown_grade", ends.join(grades, "grade_id", "left_anti"), "equivalence_id"))
        found.append(rows("relation_to_itself", relations.where("source_grade_id = target_grade_id"), "equivalence_id"))
    if rules is not None:
        found.append(rows("blank_rule_id", rules.where("trim(coalesce(rule_id, '')) = ''"), "profile"))
        found.append(repeated("repeated_rule_id", rules, F.col("rule_id")))
        found.append(rows("rule_without_source", rules.where("status = 'CONFIRMED' and trim(coalesce(source_reference, '')) = ''"), "rule_id"))
        found.append(rows("negative_tolerance", rules.where("least(tolerance1, tolerance2, tolerance3) < 0"), "rule_id"))
        found.append(repeated("several_confirmed_rules", rules.where("status = 'CONFIRMED'"), profile_key(F.col("profile"))))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def resolve_names(rows: DataFrame, name: str, grades: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` with ``grade_id``, ``canonical``, ``resolution`` (CANONICAL, ALIAS or
    UNKNOWN) and ``name_status`` (the status of the entry or alias): the canonical entry
    with the same key, else that of an alias that isn't rejected. A canonical name wins
    over an alias; of entries the one with the smallest id, of aliases that with the last."""
    keyed_entries = grades.select("grade_id", "canonical", "status", grade_match_key(F.col("canonical")).alias("_ckey"))
    canonical = keyed_entries.groupBy("_ckey").agg(F.min_by(F.struct("grade_id", "canonical", "status"), "grade_id").alias("g"))
    canonical = canonical.select("_ckey", F.col("g.grade_id").alias("_cid"), F.col("g.canonical").alias("_canonical"), F.col("g.status").alias("_cstatus"))
    used = aliases.where("status <> 'REJECTED'").select(grade_match_key(F.col("alias")).alias("_akey"), "alias_id", F.col("canonical_grade_id").alias("_aid"), F.col("status").alias("_astatus"))
    last = used.groupBy("_akey").agg(F.max_by("_aid", "alias_id").alias("_aid"), F.max_by("_astatus", "alias_id").alias("_astatus"))
    names = grades.select(F.col("grade_id").alias("_aid"), F.col("canonical").alias("_acanonical")).dropDuplicates(["_aid"])
    alias = last.join(names, "_aid")
    keyed = rows.withColumn("_key", grade_match_key(F.col(name)))
    joined = keyed.join(broadcast_if_small(canonical), F.col("_key") == F.col("_ckey"), "left").join(broadcast_if_small(alias), F.col("_key") == F.col("_akey"), "left")
    kind = F.when(F.col("_cid").isNotNull(), "CANONICAL").when(F.col("_aid").isNotNull(), "ALIAS").otherwise("UNKNOWN")
    found = [F.coalesce("_cid", "_aid").alias("grade_id"), F.coalesce("_canonical", "_acanonical").alias("canonical"), kind.alias("resolution")]
    return joined.select(*rows.columns, *found, F.when(F.col("_cid").isNotNull(), F.col("_cstatus")).otherwise(F.col("_astatus")).alias("name_status"))


def relation_edges(relations: DataFrame) -> DataFrame:
    """(a, b, relation_type, status, ordinal) of relations that aren't rejected, those
    that hold both ways also reversed; one hop, the first of a pair wins."""
    used = relations.where("status <> 'REJECTED' and source_grade_id is not null and target_grade_id is not null")
    forward = used.select(F.col("source_grade_id").alias("a"), F.col("target_grade_id").alias("b"), "relation_type", "status", F.col("equivalence_id").alias("ordinal"))
    back = used.where("bidirectional").select(F.col("target_grade_id").alias("a"), F.col("source_grade_id").alias("b"), "relation_type", "status", F.col("equivalence_id").alias("ordinal"))
    first = forward.unionByName(back).groupBy("a", "b").agg(F.min_by(F.struct("relation_type", "status", "ordinal"), "ordinal").alias("r"))
    return first.select("a", "b", "r.*")


def tolerance_pairs(items: DataFrame, rules: DataFrame, same: tuple[str, ...] = ("profile",)) -> DataFrame:
    """(offer_a, offer_b): items equal in ``same`` whose first sizes differ by at most the
    profile's tolerance: a band join. Items are put into bins as wide as the tolerance, so
    each meets only its own and the neighbouring bins. Nulls match nothing."""
    banded = items.join(broadcast_if_small(rules), "profile").where("dim1 is not null and tolerance > 0")
    a = banded.select(*same, F.col("offer_id").alias("offer_a"), F.col("dim1").alias("dim_a"), "tolerance", F.floor(F.col("dim1") / F.col("tolerance")).alias("bin"))
    b = a.select(*same, F.col("offer_a").alias("offer_b"), F.col("dim_a").alias("dim_b"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    return a.join(b, [*same, "bin"]).where("offer_a < offer_b and abs(dim_a - dim_b) <= tolerance").select(*same, "offer_a", "offer_b")


def names_of_grades(grades: DataFrame, aliases: DataFrame) -> DataFrame:
    """(grade_id, name): canonical names and aliases that aren't rejected."""
    used = aliases.where("status <> 'REJECTED'").select(F.col("canonical_grade_id").alias("grade_id"), F.col("alias").alias("name"))
    return grades.select("grade_id", F.col("canonical").alias("name")).unionByName(used).where("name is not null").distinct()


def singleton_keys(names: DataFrame) -> DataFrame:
    """(key, name) of the keys that only one spelling has."""
    keyed = names.select(grade_match_key(F.col("name")).alias("key"), "name").where("key <> ''").distinct()
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).where("n = 1").select("key", "name")


def first_rule(rules: DataFrame) -> DataFrame:
    """The first confirmed rule of each profile, by its id."""
    order = Window.partitionBy("profile").orderBy("rule_id")
    return rules.where("status = 'CONFIRMED'").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
