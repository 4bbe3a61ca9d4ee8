"""Catalogue search: queries with a profile and a grade against all items.

Queries are a small table; items of any number are scanned once. Items that no query can
tell apart but by seller and number are one group with its first offers. A group is
reached by an equi-join on profile and grade key; the tier (exact, alias, relation, fuzzy)
is decided on the distinct pairs of query and item keys, not on spellings or items. Fuzzy
pairs are found by the pieces of spelling that they must share, so no grade is compared
with every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortament.functions.dimensions import combined_score, size_similarity, sizes_match, units_agree
from sortament.functions.distances import fuzzy_similarity
from sortament.functions.profiles import search_profiles
from sortament.functions.text import grade_match_key
from sortament.operators.catalog import first_rule, names_of_grades, relation_edges, resolve_names
from sortament.operators.joins import broadcast_if_small
from sortament.session import materialise, shuffle_width

# The weight of a kind of match, and its place in the order.
TIERS = ("EXACT", "ALIAS", "CONFIRMED_RELATION", "PROPOSED_RELATION", "FUZZY")
BASE_SCORE = {"EXACT": 1.0, "ALIAS": 0.97, "CONFIRMED_RELATION": 0.9, "PROPOSED_RELATION": 0.72}
FUZZY_CEILING = 0.84
SIZES = ("dim1", "dim2", "dim3")
#: What the similarity of two keys may have beside 0.82 x the ratio of matched letters.
_BESIDE = 0.18


def _pieces(key: Column, ratio: float) -> Column:
    """What two keys must have one of in common to reach ``ratio`` of matched letters.

    Of keys of a and b letters M match, in at most a + b - 2M + 1 blocks, so they share at
    least 3M - (a + b) - 1 pairs of neighbours: one, if the ratio 2M / (a + b) is at least
    2/3 + 4/3 / (a + b). Short keys, which may fall under that, and all keys at a lower
    ratio, must share a letter."""
    letters = F.array_distinct(F.split(key, ""))
    if ratio <= 2 / 3:
        return letters
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 1, F.lit(1))), lambda i: F.substr(key, i, F.lit(2)))
    short = 4 / 3 / (ratio - 2 / 3)
    return F.array_distinct(F.when(F.length(key) <= short, F.concat(letters, pairs)).otherwise(pairs))


def fuzzy_pairs(asked: DataFrame, spelled: DataFrame, threshold: float) -> DataFrame:
    """(query_grade, item_grade, s): pairs of ``asked`` (query_grade, qk) and ``spelled``
    (item_grade, spelling) whose keys are similar by ``threshold`` or more, with the best
    similarity of the item's spellings. Complete at every threshold; at one that any two
    keys reach, each query meets each spelling."""
    ratio = (threshold - _BESIDE) / 0.82
    spelled, asked = materialise(spelled.where("spelling <> ''").distinct()), materialise(asked.where("qk <> ''").distinct())
    keys, texts = asked.select("qk").distinct(), materialise(spelled.select("spelling").distinct())
    # Edits bound the matched letters: these are a common subsequence of both.
    a, b = F.length("qk").cast("double"), F.length("spelling").cast("double")
    edits = F.levenshtein("qk", "spelling").cast("double")
    same_start = (F.substring("qk", 1, 2) == F.substring("spelling", 1, 2)).cast("double")
    lengths = 0.15 * F.least(a, b) / F.greatest(a, b)
    reach = 0.82 * 2 * F.least(a, b) / (a + b) + lengths + 0.03 >= threshold - 1e-9
    if ratio > 0:
        left = keys.withColumn("of_key", _pieces(F.col("qk"), ratio))
        left = broadcast_if_small(left.select("qk", "of_key", F.explode("of_key").alias("piece")))
        right = texts.repartition(shuffle_width(texts.sparkSession)).withColumn("of_text", _pieces(F.col("spelling"), ratio))
        met = right.select("spelling", "of_text", F.explode("of_text").alias("piece")).join(left, "piece").where(reach)
        # Each pair once: by the first piece of the key that the text has.
        met = met.where(F.col("piece") == F.get(F.array_intersect("of_key", "of_text"), F.lit(0)))
    else:
        met = texts.join(broadcast_if_small(keys), reach)
    met = met.where(0.82 * (1 - edits / (a + b)) + lengths + 0.03 * same_start >= threshold - 1e-9).select("qk", "spelling")
    similar = materialise(met).withColumn("s", fuzzy_similarity("qk", "spelling")).where(F.col("s") >= threshold)
    found = spelled.join(asked.join(similar, "qk").select("query_grade", "spelling", "s"), "spelling")
    return found.groupBy("query_grade", "item_grade").agg(F.max("s").alias("s"))


def grade_tiers(
    query_grades: DataFrame, item_grades: DataFrame, grades: DataFrame, aliases: DataFrame, relations: DataFrame | None, threshold: float, *, include_proposed: bool = True, include_fuzzy: bool = True
) -> DataFrame:
    """(qk, ik, tier, grade_score, tier_review, tier_warning) of the distinct pairs of keys
    that match: all spellings of a key have its tier. An alias needs review unless both
    names are confirmed. A relation that exists but isn't usable gives no fuzzy fallback."""

    def named(df: DataFrame, key: str) -> DataFrame:
        """One spelling of each key, with the name it resolves to."""
        one = df.select("grade", grade_match_key(F.col("grade")).alias(key)).where(F.col(key).isNotNull()).groupBy(key).agg(F.min("grade").alias("grade"))
        return resolve_names(one, "grade", grades, aliases)

    def tier(df: DataFrame, name: Column | str, score: Column | float, review: Column | bool, warning: Column | None = None) -> DataFrame:
        columns = [F.lit(x) if isinstance(x, (str, float, bool)) else x for x in (name, score, review, warning if warning is not None else F.lit(None).cast("string"))]
        return df.select("qk", "ik", *[c.alias(n) for c, n in zip(columns, ("tier", "grade_score", "tier_review", "tier_warning"), strict=True)])

    q = materialise(named(query_grades, "qk").select("qk", F.col("grade_id").alias("qid"), F.col("name_status").alias("qs")))
    i = materialise(named(item_grades, "ik").where("ik <> ''").select("ik", F.col("grade_id").alias("iid"), F.col("name_status").alias("i_s")))
    confirmed = F.coalesce((F.col("qs") == "CONFIRMED") & (F.col("i_s") == "CONFIRMED"), F.lit(False))
    exact = tier(q.join(i, q["qk"] == i["ik"]), "EXACT", 1.0, False)
    alias = tier(q.join(i, (q["qid"] == i["iid"]) & (q["qk"] != i["ik"])), "ALIAS", BASE_SCORE["ALIAS"], ~confirmed, F.when(~confirmed, "ALIAS_NOT_CONFIRMED"))
    known = exact.unionByName(alias)
    if relations is not None:
        related = q.join(relation_edges(relations), F.col("qid") == F.col("a")).join(i, F.col("b") == F.col("iid"))
        sure = F.coalesce(F.col("status") == "CONFIRMED", F.lit(False))
        whole = F.coalesce(F.upper(F.trim("relation_type")) == "EQUIVALENT", F.lit(False))
        kind, score = (F.when(sure, F.lit(x)).otherwise(F.lit(y)) for x, y in (("CONFIRMED_RELATION", "PROPOSED_RELATION"), (BASE_SCORE["CONFIRMED_RELATION"], BASE_SCORE["PROPOSED_RELATION"])))
        warning = F.when(~sure, "RELATION_NOT_CONFIRMED").when(~whole, "RELATION_APPROXIMATE")
        relation = tier(related, kind, score, ~(sure & whole), warning)
        known = known.unionByName(relation.join(known.select("qk", "ik"), ["qk", "ik"], "left_anti"))
    known = materialise(known)  # distinct pairs of keys, not of items
    shown = known if include_proposed else known.where("tier <> 'PROPOSED_RELATION'")
    if not include_fuzzy:
        return shown
    # The item's spelling and all names of its grade.
    others = i.join(names_of_grades(grades, aliases).select(F.col("grade_id").alias("iid"), grade_match_key(F.col("name")).alias("spelling")), "iid").select(F.col("ik").alias("item_grade"), "spelling")
    spelled = i.select(F.col("ik").alias("item_grade"), F.col("ik").alias("spelling")).unionByName(others)
    similar = fuzzy_pairs(q.select(F.col("qk").alias("query_grade"), "qk"), spelled, threshold).select(F.col("query_grade").alias("qk"), F.col("item_grade").alias("ik"), "s").join(known.select("qk", "ik"), ["qk", "ik"], "left_anti")
    return shown.unionByName(tier(similar, "FUZZY", F.least("s", F.lit(FUZZY_CEILING)), True, F.lit("FUZZY_IS_NO_EQUIVALENCE")))


def _order(tier: Column, near: Column) -> Column:
    place = F.lit(len(TIERS))
    for n, name in enumerate(TIERS):
        place = F.when(tier == name, n).otherwise(place)
    return F.when(near, len(TIERS)).otherwise(place)


def suppress_near(hits: DataFrame, by: str) -> DataFrame:
    """``hits`` without those that don't ``fits`` where another of the same ``by`` does."""
    any_exact = hits.groupBy(by).agg(F.max("fits").alias("_has_exact"))
    return hits.join(broadcast_if_small(any_exact), by).where("fits or not _has_exact").drop("_has_exact")


def _item_groups(items: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(gid, profile, ik, dim1, dim2, dim3, dim1_unit, grade, best): items of the profiles
    asked for that differ in nothing that a query of their profile asks, with one of their
    spellings and their first ``limit`` by seller and number. Sizes and units that no query
    of the profile asks for are null."""
    sized = F.col("q1").isNotNull() | F.col("q2").isNotNull() | F.col("q3").isNotNull()
    asks = asked.groupBy("profile").agg(*[F.bool_or(F.col(f"q{n}").isNotNull()).alias(f"asks{n}") for n in (1, 2, 3)], F.bool_or(F.col("q_unit").isNotNull() & sized).alias("asks_unit"))
    used = [F.when(F.col(f"asks{n}"), F.col(c)).alias(c) for n, c in enumerate(SIZES, 1)]
    rows = items.join(broadcast_if_small(asks), "profile").select("profile", grade_match_key(F.col("grade")).alias("ik"), *used, F.when(F.col("asks_unit"), F.col("dim1_unit")).alias("dim1_unit"), "grade", F.lower("supplier").alias("seller"), "offer_id")
    by = ["profile", "ik", *SIZES, "dim1_unit"]
    # A window limit: no group is gathered beyond its first ``limit`` items.
    first = rows.where("ik <> ''").withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("seller", "offer_id"))).where(F.col("n") <= limit)
    groups = first.groupBy(*by).agg(F.min("grade").alias("grade"), F.sort_array(F.collect_list(F.struct("seller", "offer_id"))).alias("best"))
    return materialise(groups.withColumn("gid", F.monotonically_increasing_id()))


def catalog_search(
    queries: DataFrame,
    items: DataFrame,
    grades: DataFrame,
    aliases: DataFrame,
    relations: DataFrame | None = None,
    rules: DataFrame | None = None,
    *,
    threshold: float = 0.82,
    limit: int = 20,
    include_proposed: bool = True,
    include_fuzzy: bool = True,
    include_unruled_near: bool = True,
) -> DataFrame:
    """The best ``limit`` items of each query: (query_id, offer_id, tier, match_type, score,
    requires_review, tie, rule_id, warnings, query_warnings, position).

    ``queries``: (query_id, profile, grade, q1, q2, q3, q_unit). A null size asks for
    nothing. If any item of a query has its sizes, others are left out; else items come
    by the nearness of their sizes and need review. Where the profile asked for has a
    confirmed rule (``rules``: rule_id, profile, tolerance1, tolerance2, tolerance3,
    status), each asked size must be within its tolerance; where it has none, near items
    come with ``include_unruled_near``. ``include_proposed`` and ``include_fuzzy``: whether
    relations that aren't confirmed and similar spellings count.

    ``tie``: a fuzzy hit as good as one of another grade. Ties and the query's warnings
    (all need review, a tie) count all hits, before the limit. An empty table of items or
    queries gives no rows; a null grade or profile matches nothing.
    """
    if not 1 <= limit <= 200 or not 0 <= threshold <= 1:
        raise ValueError("limit is 1 to 200 and threshold 0 to 1")
    asked = queries.where("query_id is not null").select("query_id", F.upper(F.trim("profile")).alias("asked_profile"), grade_match_key(F.col("grade")).alias("qk"), "q1", "q2", "q3", "q_unit")
    if rules is not None:
        first = first_rule(rules).select(F.upper(F.trim("profile")).alias("asked_profile"), "rule_id", "tolerance1", "tolerance2", "tolerance3")
        asked = asked.join(broadcast_if_small(first), "asked_profile", "left")
    else:
        asked = asked.select("*", F.lit(None).cast("string").alias("rule_id"), *[F.lit(None).cast("decimal(18,6)").alias(f"tolerance{n}") for n in (1, 2, 3)])
    asked = materialise(asked.withColumn("profile", F.explode(search_profiles(F.col("asked_profile")))))
    # Only items of a profile that is asked for are read further, and only their grades compared.
    groups = _item_groups(items, asked, limit)
    tiers = grade_tiers(queries, groups, grades, aliases, relations, threshold, include_proposed=include_proposed, include_fuzzy=include_fuzzy)
    wanted = materialise(asked.join(tiers, "qk"))
    want, have = [F.col(c) for c in ("q1", "q2", "q3")], [F.col(c) for c in SIZES]
    no_size = F.col("q1").isNull() & F.col("q2").isNull() & F.col("q3").isNull()
    exact = no_size | (sizes_match(want, have) & units_agree(F.col("q_unit"), F.col("dim1_unit")))
    near = F.coalesce(size_similarity(want, have), F.lit(1.0))
    within = F.lit(True)
    for n, (w, h) in enumerate(zip(want, have, strict=True), 1):
        within = within & (w.isNull() | F.coalesce(F.abs(w - h) <= F.col(f"tolerance{n}"), F.lit(False)))
    allowed = F.when(F.col("rule_id").isNotNull(), within).otherwise(F.lit(include_unruled_near))
    width = shuffle_width(asked.sparkSession)

    def hits(wanted: DataFrame, which: Column, fits: bool) -> DataFrame:
        """The groups that ``wanted`` reach, scored; written without those not ``which``."""
        met = groups.repartition(width, "profile", "ik").join(wanted.repartition(width, "profile", "ik"), ["profile", "ik"]).where(which)
        sizes_score = F.when(no_size, F.lit(None).cast("double")).otherwise(F.lit(1.0) if fits else near)
        deltas = [F.abs(w - h).alias(f"delta{n}") for n, (w, h) in enumerate(zip(want, have, strict=True), 1)]
        first = F.col("best")[0]
        return materialise(met.select(
            "query_id", "gid", "ik", "tier", "tier_warning", "rule_id", F.lit(fits).alias("fits"), (F.col("tier_review") | F.lit(not fits)).alias("requires_review"),
            F.round(combined_score(F.col("grade_score"), sizes_score), 6).alias("score"), F.round("grade_score", 6).alias("tg"), F.round(F.coalesce(sizes_score, F.lit(-1.0)), 6).alias("ts"),
            *deltas, first["seller"].alias("seller"), first["offer_id"].alias("offer_id"),
        ))

    # Near sizes are looked for only by queries that no item fits.
    fitting = hits(wanted, exact, True)
    rest = materialise(wanted.join(fitting.select("query_id").distinct(), "query_id", "left_anti"))
    kept = fitting.unionByName(hits(rest, ~exact & (near > 0) & allowed, False))
    kept = kept.withColumn("match_type", F.when(F.col("fits"), F.col("tier")).otherwise("NEAR_DIMENSION"))
    # Whether all hits need review, and whether grades share a fuzzy score, are aggregates
    # of few rows joined to the best hits: no window gathers all hits of a query.
    key = F.when(F.col("match_type") == "FUZZY", F.col("ik"))
    scores = materialise(kept.groupBy("query_id", "tg", "ts").agg(F.every("requires_review").alias("review"), F.coalesce(F.min(key) < F.max(key), F.lit(False)).alias("tied")))
    of_query = scores.groupBy("query_id").agg(F.every("review").alias("all_review"), F.bool_or("tied").alias("any_tie"))
    deltas = [F.col(f"delta{n}").asc_nulls_last() for n in (1, 2, 3)]
    best = Window.partitionBy("query_id").orderBy(_order(F.col("tier"), ~F.col("fits")), "requires_review", F.col("score").desc(), *deltas, "seller", "offer_id")
    # A group stands where its first item does, so the best ``limit`` items are in the best
    # ``limit`` groups. Spark keeps these of each query before the shuffle.
    leading = kept.withColumn("position", F.row_number().over(best)).where(F.col("position") <= limit).drop("position", "seller", "offer_id")
    listed = leading.join(groups.select("gid", "best"), "gid").select("*", F.inline("best")).drop("best")
    top = listed.withColumn("position", F.row_number().over(best)).where(F.col("position") <= limit)
    top = top.join(scores.select("query_id", "tg", "ts", "tied"), ["query_id", "tg", "ts"]).join(of_query, "query_id")
    top = top.withColumn("tie", (F.col("match_type") == "FUZZY") & F.col("tied"))
    near_warning = F.when(~F.col("fits"), F.when(F.col("rule_id").isNull(), "NEAR_SIZE_WITHOUT_RULE").otherwise("NEAR_SIZE_NEEDS_CONFIRMATION"))
    warnings = F.array_compact(F.array("tier_warning", near_warning, F.when(F.col("tie"), "AMBIGUOUS_FUZZY_TIE")))
    about = F.array_compact(F.array(F.when(F.col("any_tie"), "AMBIGUOUS_FUZZY_TIE"), F.when(F.col("all_review"), "ALL_NEED_REVIEW")))
    rule = F.when(~F.col("fits"), F.col("rule_id")).alias("rule_id")
    return top.select("query_id", "offer_id", "tier", "match_type", "score", "requires_review", "tie", rule, warnings.alias("warnings"), about.alias("query_warnings"), F.col("position").cast("long").alias("position"))


def search_warnings(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, warnings) of every query: those of its hits, or NOTHING_FOUND. Nothing is
    ever applied by a search."""
    told = hits.groupBy("query_id").agg(F.first("query_warnings").alias("w"))  # the same in all of a query's hits
    joined = queries.select("query_id").distinct().join(told, "query_id", "left")
    return joined.select("query_id", F.coalesce("w", F.array(F.lit("NOTHING_FOUND"))).alias("warnings"))
