"""Typed profiles to those of the inventory at hand, without a list of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortament.functions.distances import acceptable_edits, osa_distance
from sortament.functions.profiles import ROUND_BARS, search_profiles
from sortament.functions.text import profile_key
from sortament.operators.joins import broadcast_if_small


def available_profiles(items: DataFrame) -> DataFrame:
    """(key, profile, items): the inventory's profiles and how many items have each; where
    one name of round bars occurs, both are there. Blank profiles are none."""
    keyed = items.select(profile_key(F.col("profile")).alias("key"), F.upper(F.trim("profile")).alias("profile")).where("key <> ''")
    counted = keyed.groupBy("key").agg(F.min("profile").alias("profile"), F.count(F.lit(1)).alias("items"))
    other = F.when(F.col("key") == ROUND_BARS[0], ROUND_BARS[1]).when(F.col("key") == ROUND_BARS[1], ROUND_BARS[0])
    twins = counted.where(other.isNotNull()).select(other.alias("key"), other.alias("profile"), F.lit(0).cast("long").alias("items"))
    return counted.unionByName(twins).groupBy("key").agg(F.max_by("profile", "items").alias("profile"), F.max("items").alias("items"))


def resolve_profiles(items: DataFrame, queries: DataFrame, query: str = "query") -> DataFrame:
    """(query, status, profile, matched, edits) for each distinct query text.

    ``status``: ALL for a blank query; EXACT if the inventory has the profile, whatever the
    case; CORRECTED if exactly one of its profiles is nearest, within one edit or swap (two
    from nine letters on); else NOT_FOUND. ``matched``: the profile with its other name, if
    it is a round bar. Only profiles of nearly equal length are compared, so the work is
    that of an equi-join on the length. A null query is a blank one."""
    known = available_profiles(items)
    asked = queries.select(F.coalesce(F.col(query), F.lit("")).alias("query")).distinct().withColumn("q", profile_key(F.col("query")))
    near = asked.where("q <> ''").withColumn("n", F.explode(F.sequence(F.length("q") - 2, F.length("q") + 2)))
    met = near.join(broadcast_if_small(known.withColumn("n", F.length("key"))), "n")
    scored = met.withColumn("edits", osa_distance("q", "key")).where((F.col("edits") == 0) | acceptable_edits(F.col("edits"), F.greatest(F.length("q"), F.length("key"))))
    least = scored.groupBy("query").agg(F.min("edits").alias("edits"))
    best = scored.join(least, ["query", "edits"]).groupBy("query", "edits").agg(F.count(F.lit(1)).alias("ties"), F.min("profile").alias("profile"))
    best = best.where("ties = 1")
    joined = asked.join(best, "query", "left")
    status = F.when(F.col("q") == "", "ALL").when(F.col("edits") == 0, "EXACT").when(F.col("edits").isNotNull(), "CORRECTED").otherwise("NOT_FOUND")
    return joined.select("query", status.alias("status"), "profile", F.when(F.col("profile").isNotNull(), search_profiles(F.col("profile"))).alias("matched"), F.col("edits").cast("int").alias("edits"))
