"""Queries of the catalogue, search, review and record operators, over the tables of price lists.

Each has its SQL beside it where SQL can say the same; the others are tested on fixtures.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortament.functions import attributes
from sortament.functions import dimensions as dim
from sortament.functions import profiles, size_text, text, values
from sortament.functions.distances import osa_distance
from sortament.operators import catalog, decision_log, documents, evidence, listing, mail, metrics, search_catalog, search_mask
from sortament.operators.adapters import read_price_lists
from sortament.operators.candidates import candidates, payload
from sortament.operators.cells import detect_headers, fill_down, stack_blocks
from sortament.operators.find_names import find_names
from sortament.operators.parse_items import parse_items
from sortament.operators.persist import stable_id
from sortament.operators.read_grades import grades_in_text, known_names, normalise_grades
from sortament.operators.read_sizes import sizes_in_text
from sortament.operators.reject_rows import split_line
from sortament.operators.resolve_profile import resolve_profiles
from sortament.sources.exports import source_text
from sortament.tables import read_table

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Cyrillic capitals as other signs in SQL, whose distances count bytes.
_ASCII = "translate({0}, 'АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ', 'abcdefghijklmnopqrstuvwxyz!#$%&;')"
#: ``compact_key`` in SQL.
_KEY = r"regexp_replace(translate(upper({0}), 'АВЕКМНОРСТУХЁ', 'ABEKMHOPCTYXE'), '[^\p{{L}}\p{{Nd}}]+', '', 'g')"


def _size_search(profile_list: tuple[str, ...], size: str) -> tuple[search_mask.Mask, tuple[str, ...]]:
    return search_mask.Mask("", sizes=(Decimal(size),), profiles=profile_list, asked_profile=profile_list[0]), profile_list


@_query("""SELECT offer_id, round(CAST(abs(dim1 - 20) AS DOUBLE), 6) AS size_delta, CASE WHEN dim1 = 20 THEN 'ТОЧНОЕ' ELSE 'БЛИЖАЙШИЙ РАЗМЕР' END AS match_type
  FROM offers WHERE profile = 'КРУГ' AND dim1 IS NOT NULL""")
def mask_search_nearest(spark: SparkSession, folder: str) -> DataFrame:
    mask, _ = _size_search(("КРУГ",), "20")
    return search_mask.mask_search(read_table(spark, folder, "offers"), mask).select("offer_id", "size_delta", "match_type")


@_query(
    f"""WITH g AS (SELECT {_KEY.format("grade")} AS k, count(*) AS n FROM offers WHERE grade IS NOT NULL GROUP BY 1 HAVING k <> ''),
  best AS (SELECT k FROM g ORDER BY n DESC, k LIMIT 1)
  SELECT offer_id, 0.0::DOUBLE AS size_delta, 'ТОЧНОЕ' AS match_type FROM offers, best WHERE {_KEY.format("grade")} = k"""
)
def mask_search_wildcard(spark: SparkSession, folder: str) -> DataFrame:
    """A grade alone, whatever the profile and the sizes: the commonest one."""
    offers = read_table(spark, folder, "offers")
    keys = offers.where("grade is not null").groupBy(text.compact_key(F.col("grade")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    best = keys.where("k <> ''").orderBy(F.col("n").desc(), "k").limit(1).collect()  # one row
    mask = search_mask.Mask("", grade_key=best[0]["k"] if best else None)
    return search_mask.mask_search(offers, mask).select("offer_id", "size_delta", "match_type")


@_query("SELECT offer_id, profile FROM offers WHERE profile IN ('КРУГ', 'ПРУТОК')")
def profile_group_filter(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "offers").where(F.col("profile").isin(*profiles.ROUND_BARS)).select("offer_id", "profile")


@_query("""SELECT offer_id, profile AS display_profile, false AS is_profile_alias FROM offers
  UNION ALL SELECT offer_id, CASE profile WHEN 'КРУГ' THEN 'ПРУТОК' ELSE 'КРУГ' END, true FROM offers WHERE profile IN ('КРУГ', 'ПРУТОК')""")
def round_bar_expand(spark: SparkSession, folder: str) -> DataFrame:
    return search_mask.expand_round_bars(read_table(spark, folder, "offers")).select("offer_id", "display_profile", "is_profile_alias")


@_query("""WITH h AS (SELECT offer_id, profile, coalesce(dim1 = 20, false) AS fits FROM offers WHERE profile IS NOT NULL)
  SELECT offer_id, fits FROM (SELECT *, max(fits) OVER (PARTITION BY profile) AS any_fit FROM h) WHERE fits OR NOT any_fit""")
def exact_suppresses_near(spark: SparkSession, folder: str) -> DataFrame:
    """Per profile: the offers of diameter 20, or all where there is none."""
    hits = read_table(spark, folder, "offers").where("profile is not null").select("offer_id", "profile", F.coalesce(F.col("dim1") == 20, F.lit(False)).alias("fits"))
    return search_catalog.suppress_near(hits, "profile").select("offer_id", "fits")


@_query("""SELECT profile, offer_id, position FROM (SELECT profile, offer_id, row_number() OVER (PARTITION BY profile ORDER BY price_rub_kg, offer_id) AS position
  FROM offers WHERE profile IS NOT NULL AND price_rub_kg IS NOT NULL) WHERE position <= 5""")
def topk_per_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The five cheapest offers of each profile; Spark keeps five a task before the shuffle."""
    priced = read_table(spark, folder, "offers").where("profile is not null and price_rub_kg is not null")
    order = F.row_number().over(Window.partitionBy("profile").orderBy("price_rub_kg", "offer_id"))
    return priced.withColumn("position", order.cast("long")).where("position <= 5").select("profile", "offer_id", "position")


@_query("""SELECT offer_id, round(CASE WHEN dim1 IS NULL OR dim2 IS NULL THEN 0.0 ELSE
    (greatest(0.0, 1 - CAST(abs(20 - dim1) AS DOUBLE) / 20.0) + greatest(0.0, 1 - CAST(abs(1000 - dim2) AS DOUBLE) / 1000.0)) / 2 END, 9) AS similarity FROM offers""")
def size_similarity_score(spark: SparkSession, folder: str) -> DataFrame:
    wanted = [F.lit(20).cast("decimal(18,6)"), F.lit(1000).cast("decimal(18,6)"), F.lit(None).cast("decimal(18,6)")]
    have = [F.col("dim1"), F.col("dim2"), F.col("dim3")]
    return read_table(spark, folder, "offers").select("offer_id", F.round(dim.size_similarity(wanted, have), 9).alias("similarity"))


@_query(
    f"""WITH c AS (SELECT {_KEY.format("canonical")} AS k, any_value(grade_id) AS cid FROM grades GROUP BY 1),
  a AS (SELECT {_KEY.format("alias")} AS k, arg_max(canonical_grade_id, alias_id) AS aid FROM aliases WHERE status <> 'REJECTED' GROUP BY 1)
  SELECT offer_id, coalesce(cid, aid) AS grade_id, CASE WHEN cid IS NOT NULL THEN 'CANONICAL' WHEN aid IS NOT NULL THEN 'ALIAS' ELSE 'UNKNOWN' END AS resolution
  FROM offers o LEFT JOIN c ON {_KEY.format("grade")} = c.k LEFT JOIN a ON {_KEY.format("grade")} = a.k"""
)
def grade_alias_resolve(spark: SparkSession, folder: str) -> DataFrame:
    tables = [read_table(spark, folder, t) for t in ("offers", "grades", "aliases")]
    return catalog.resolve_names(tables[0].select("offer_id", "grade"), "grade", tables[1], tables[2]).select("offer_id", "grade_id", "resolution")


@_query("""WITH u AS (SELECT * FROM equivalences WHERE status <> 'REJECTED' AND source_grade_id IS NOT NULL AND target_grade_id IS NOT NULL),
  e AS (SELECT source_grade_id AS a, target_grade_id AS b, relation_type, equivalence_id AS ordinal FROM u
    UNION ALL SELECT target_grade_id, source_grade_id, relation_type, equivalence_id FROM u WHERE bidirectional)
  SELECT a, b, relation_type, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ordinal) AS n FROM e) WHERE n = 1""")
def grade_relation_edges(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.relation_edges(read_table(spark, folder, "equivalences")).select("a", "b", "relation_type", "ordinal")


@_query(
    f"""WITH c AS (SELECT grade_id, {_KEY.format("canonical")} AS k FROM grades), a AS (SELECT alias_id, canonical_grade_id AS g, {_KEY.format("alias")} AS k FROM aliases)
  SELECT 'repeated_canonical_key' AS "check", k AS subject FROM c GROUP BY k HAVING count(*) > 1
  UNION ALL SELECT 'repeated_grade_id', grade_id FROM grades GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'repeated_alias_id', alias_id FROM aliases GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'confirmed_without_source', grade_id FROM grades WHERE status = 'CONFIRMED' AND trim(coalesce(source_reference, '')) = ''
  UNION ALL SELECT DISTINCT 'alias_without_grade', alias_id FROM aliases WHERE canonical_grade_id NOT IN (SELECT grade_id FROM grades)
  UNION ALL SELECT DISTINCT 'alias_is_other_canonical', alias_id FROM a JOIN c USING (k) WHERE g <> grade_id
  UNION ALL SELECT 'alias_of_several_grades', k FROM a GROUP BY k HAVING count(DISTINCT g) > 1"""
)
def catalog_violations(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.catalog_violations(read_table(spark, folder, "grades"), read_table(spark, folder, "aliases"))


@_query(
    f"""WITH c AS (SELECT grade_id, {_KEY.format("written_name")} AS k FROM grade_cards)
  SELECT 'repeated_canonical_key' AS "check", k AS subject FROM c WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1
  UNION ALL SELECT 'repeated_grade_id', grade_id FROM grade_cards WHERE grade_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'blank_id', written_name FROM grade_cards WHERE trim(coalesce(grade_id, '')) = ''
  UNION ALL SELECT DISTINCT 'confirmed_without_source', grade_id FROM grade_cards WHERE status = 'CONFIRMED' AND trim(coalesce(standard_system, '')) = ''
  UNION ALL SELECT DISTINCT 'relation_to_unknown_grade', CAST(equivalence_id AS VARCHAR) FROM (SELECT equivalence_id, unnest([source_grade_id, target_grade_id]) AS g FROM equivalences)
    WHERE g IS NULL OR g NOT IN (SELECT grade_id FROM grade_cards WHERE grade_id IS NOT NULL)
  UNION ALL SELECT DISTINCT 'relation_to_itself', CAST(equivalence_id AS VARCHAR) FROM equivalences WHERE source_grade_id = target_grade_id"""
)
def relation_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The cards as a catalogue, with the statements between them."""
    cards = read_table(spark, folder, "grade_cards").select("grade_id", F.col("written_name").alias("canonical"), "status", F.col("standard_system").alias("source_reference"))
    return catalog.catalog_violations(cards, read_table(spark, folder, "aliases").where("false"), read_table(spark, folder, "equivalences"))


@_query(f"SELECT k AS key, min(canonical) AS name FROM (SELECT DISTINCT {_KEY.format('canonical')} AS k, canonical FROM (SELECT canonical FROM grades UNION ALL SELECT alias FROM aliases)) WHERE k <> '' GROUP BY k HAVING count(*) = 1")
def singleton_keys(spark: SparkSession, folder: str) -> DataFrame:
    names = read_table(spark, folder, "grades").select(F.col("canonical").alias("name")).unionByName(read_table(spark, folder, "aliases").select(F.col("alias").alias("name")))
    return catalog.singleton_keys(names)


@_query("""SELECT a.profile, a.grade, a.dim2, a.offer_id AS offer_a, b.offer_id AS offer_b
  FROM offers a JOIN offers b ON a.profile = b.profile AND a.grade = b.grade AND a.dim2 = b.dim2 AND a.offer_id < b.offer_id WHERE abs(a.dim1 - b.dim1) <= 0.5""")
def tolerance_band_join(spark: SparkSession, folder: str) -> DataFrame:
    """Offers of one profile, grade and second size whose first sizes differ by half a unit at most."""
    offers = read_table(spark, folder, "offers")
    rules = offers.where("profile is not null").select("profile", F.lit("0.5").cast("decimal(18,6)").alias("tolerance")).distinct()
    return catalog.tolerance_pairs(offers.select("profile", "grade", "dim2", "offer_id", "dim1"), rules, ("profile", "grade", "dim2"))


@_query("SELECT profile, offer_id FROM offers WHERE dim1_unit IS NULL OR upper(dim1_unit) = 'MM'")
def unit_compat_filter(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "offers").where(dim.units_agree(F.lit("MM"), F.upper("dim1_unit"))).select("profile", "offer_id")


@_query(f"""SELECT DISTINCT profile, CAST(damerau_levenshtein({_ASCII.format("'ТРУАБ'")}, {_ASCII.format("profile")}) AS INT) AS distance FROM offers WHERE profile IS NOT NULL""")
def profile_typo_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Optimal string alignment of a mistyped profile with the profiles on offer."""
    named = read_table(spark, folder, "offers").where("profile is not null").select("profile").distinct()
    return named.select("profile", osa_distance(F.lit("ТРУАБ"), F.col("profile")).alias("distance"))


@_query(rf"""WITH p AS (SELECT DISTINCT upper(trim(regexp_replace(profile, '\s+', ' ', 'g'))) AS k FROM offers WHERE trim(coalesce(profile, '')) <> ''),
  known AS (SELECT k FROM p UNION SELECT CASE k WHEN 'КРУГ' THEN 'ПРУТОК' ELSE 'КРУГ' END FROM p WHERE k IN ('КРУГ', 'ПРУТОК')),
  q AS (SELECT DISTINCT item_id, coalesce(regexp_extract(upper(translate(description, 'ёЁ', 'еЕ')), '[0-9A-ZА-Я]+'), '') AS query FROM raw_items),
  d AS (SELECT item_id, query, k, damerau_levenshtein({_ASCII.format('query')}, {_ASCII.format('k')}) AS e FROM q JOIN known ON abs(length(query) - length(k)) <= 2 WHERE query <> ''),
  near AS (SELECT * FROM d WHERE e <= 1 OR (e = 2 AND greatest(length(query), length(k)) >= 9)),
  best AS (SELECT query, min(k) AS k, e FROM (SELECT DISTINCT query, k, e, min(e) OVER (PARTITION BY query) AS m FROM near) WHERE e = m GROUP BY query, e HAVING count(*) = 1)
  SELECT DISTINCT q.query, CASE WHEN q.query = '' THEN 'ALL' WHEN e = 0 THEN 'EXACT' WHEN e IS NOT NULL THEN 'CORRECTED' ELSE 'NOT_FOUND' END AS status, k AS profile, CAST(e AS INT) AS edits FROM q LEFT JOIN best USING (query)""")
def profile_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """The first word of every raw description as a typed profile, against the profiles on offer."""
    first = F.regexp_extract(F.upper(F.translate("description", "ёЁ", "еЕ")), "[0-9A-ZА-Я]+", 0)
    queries = read_table(spark, folder, "raw_items").select(F.coalesce(first, F.lit("")).alias("query"))
    return resolve_profiles(read_table(spark, folder, "offers"), queries).select("query", "status", "profile", "edits")


def _catalogue_asked(spark: SparkSession, folder: str, size: int | None, unit: str | None) -> tuple[list[DataFrame], DataFrame]:
    """Every canonical grade as a pipe, bar and sheet query of a size; the tables to search:
    items, grades, aliases, and relations between grades as the cards of both ends name them."""
    grades, aliases = read_table(spark, folder, "grades"), read_table(spark, folder, "aliases")
    kinds = F.explode(F.array(F.lit("ТРУБА"), F.lit("КРУГ"), F.lit("ЛИСТ"))).alias("profile")
    nothing = F.lit(None).cast("decimal(18,6)")
    asked = grades.select("grade_id", F.col("canonical").alias("grade"), kinds)
    queries = asked.select(F.concat_ws("/", "grade_id", "profile").alias("query_id"), "profile", "grade", F.lit(size).cast("decimal(18,6)").alias("q1"), nothing.alias("q2"), nothing.alias("q3"), F.lit(unit).cast("string").alias("q_unit"))
    cards = catalog.resolve_names(read_table(spark, folder, "grade_cards").select(F.col("grade_id").alias("card_id"), "written_name"), "written_name", grades, aliases).where("grade_id is not null")
    ends = [cards.select(F.col("card_id").alias(f"{end}_grade_id"), F.col("grade_id").alias(f"_{end}")) for end in ("source", "target")]
    related = read_table(spark, folder, "equivalences").join(ends[0], "source_grade_id").join(ends[1], "target_grade_id")
    relations = related.select("equivalence_id", F.col("_source").alias("source_grade_id"), F.col("_target").alias("target_grade_id"), "relation_type", "status", "bidirectional")
    items = read_table(spark, folder, "offers").select("offer_id", "supplier", "profile", "grade", "dim1", "dim2", "dim3", F.upper("dim1_unit").alias("dim1_unit"))
    return [items, grades, aliases, relations], queries


@_query()
def catalog_search_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best offers of each query, by all tiers and with near sizes."""
    tables, queries = _catalogue_asked(spark, folder, 20, "MM")
    return search_catalog.catalog_search(queries, *tables, limit=10)


_RESOLVED = f"""c AS (SELECT {_KEY.format("canonical")} AS k, min(grade_id) AS id, arg_min(status, grade_id) AS st FROM grades GROUP BY 1),
  a AS (SELECT {_KEY.format("alias")} AS k, arg_max(canonical_grade_id, alias_id) AS id, arg_max(status, alias_id) AS st FROM aliases WHERE status <> 'REJECTED' GROUP BY 1),
  names AS (SELECT k, coalesce(c.id, a.id) AS id, CASE WHEN c.id IS NOT NULL THEN c.st ELSE a.st END AS st FROM c FULL JOIN a USING (k))"""


@_query(
    f"""WITH {_RESOLVED},
  q AS (SELECT grade_id || '/' || p AS query_id, p, {_KEY.format("canonical")} AS qk FROM grades, (VALUES ('ТРУБА'), ('КРУГ'), ('ЛИСТ')) t(p)),
  q2 AS (SELECT query_id, unnest(CASE WHEN p = 'КРУГ' THEN ['КРУГ', 'ПРУТОК'] ELSE [p] END) AS profile, qk, id AS qid, st AS qs FROM q LEFT JOIN names ON qk = k),
  i AS (SELECT offer_id, supplier, profile, {_KEY.format("grade")} AS ik FROM offers),
  i2 AS (SELECT i.*, id AS iid, st AS ist FROM i LEFT JOIN names ON ik = k WHERE ik <> ''),
  cards AS (SELECT grade_id AS card, id FROM grade_cards JOIN names ON {_KEY.format("written_name")} = k),
  r AS (SELECT s.id AS a, t.id AS b, relation_type, status, bidirectional, equivalence_id AS n FROM equivalences e JOIN cards s ON e.source_grade_id = s.card JOIN cards t ON e.target_grade_id = t.card WHERE status <> 'REJECTED'),
  edges AS (SELECT a, b, arg_min(relation_type, n) AS kind, arg_min(status, n) AS st FROM (SELECT a, b, relation_type, status, n FROM r UNION ALL SELECT b, a, relation_type, status, n FROM r WHERE bidirectional) GROUP BY a, b),
  hits AS (SELECT query_id, offer_id, supplier, CASE WHEN qk = ik THEN 0 WHEN qid = iid THEN 1 WHEN edges.st = 'CONFIRMED' THEN 2 WHEN edges.a IS NOT NULL THEN 3 END AS tier,
      CASE WHEN qk = ik THEN false WHEN qid = iid THEN NOT coalesce(qs = 'CONFIRMED' AND ist = 'CONFIRMED', false) ELSE NOT coalesce(edges.st = 'CONFIRMED' AND upper(trim(edges.kind)) = 'EQUIVALENT', false) END AS review
    FROM q2 JOIN i2 USING (profile) LEFT JOIN edges ON qid = edges.a AND iid = edges.b),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, review, lower(supplier) NULLS FIRST, offer_id) AS position FROM hits WHERE tier IS NOT NULL)
  SELECT query_id, offer_id, ['EXACT', 'ALIAS', 'CONFIRMED_RELATION', 'PROPOSED_RELATION'][tier + 1] AS tier, review AS requires_review, position,
    [1.0, 0.97, 0.9, 0.72][tier + 1]::DOUBLE AS score FROM ranked WHERE position <= 10"""
)
def catalog_search_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Queries without size and by all tiers but similar spellings, which SQL can't say."""
    tables, queries = _catalogue_asked(spark, folder, None, None)
    found = search_catalog.catalog_search(queries, *tables, limit=10, include_fuzzy=False, include_unruled_near=False)
    return found.select("query_id", "offer_id", "tier", "requires_review", "position", "score")


@_query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_decision(spark: SparkSession, folder: str) -> DataFrame:
    return decision_log.latest(read_table(spark, folder, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@_query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_id FROM events")
def previous_decision(spark: SparkSession, folder: str) -> DataFrame:
    return decision_log.with_previous(read_table(spark, folder, "events"), "user_id", "event_id", "ts", "event_id").select("event_id", "previous_id")


_LOG_SQL = "(SELECT user_id AS c_custkey, event_id, ts, CASE WHEN event_type = 'view' THEN 'DEFER' ELSE 'CONFIRM' END AS action FROM events)"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    action = F.when(F.col("event_type") == "view", "DEFER").otherwise("CONFIRM")
    return read_table(spark, folder, "events").select(F.col("user_id").alias("c_custkey"), "event_id", "ts", action.alias("action"))


@_query(
    f"""WITH l AS (SELECT c_custkey, arg_max(action, (ts, event_id)) AS a FROM {_LOG_SQL} GROUP BY 1)
  SELECT c.c_custkey, CASE WHEN a IS NULL THEN 'UNRESOLVED' WHEN a = 'DEFER' THEN 'DEFERRED' ELSE 'RESOLVED' END AS state FROM customer c LEFT JOIN l USING (c_custkey)"""
)
def review_queue_states(spark: SparkSession, folder: str) -> DataFrame:
    return decision_log.queue_states(read_table(spark, folder, "customer"), _log(spark, folder), "c_custkey", "action", "ts", "event_id").select("c_custkey", "state")


@_query(
    f"""WITH l AS (SELECT c_custkey, arg_max(action, (ts, event_id)) AS a FROM {_LOG_SQL} GROUP BY 1)
  SELECT count(*) AS total, count(*) FILTER (a <> 'DEFER') AS resolved, count(*) FILTER (a = 'DEFER') AS deferred, count(*) FILTER (a IS NULL OR a = 'DEFER') AS unresolved
  FROM customer LEFT JOIN l USING (c_custkey)"""
)
def unresolved_queue(spark: SparkSession, folder: str) -> DataFrame:
    states = decision_log.queue_states(read_table(spark, folder, "customer"), _log(spark, folder), "c_custkey", "action", "ts", "event_id")
    return decision_log.state_counts(states)


@_query("SELECT DISTINCT source_grade_id AS grade_id FROM equivalences WHERE source_grade_id IS NOT NULL AND source_grade_id NOT IN (SELECT grade_id FROM grade_cards)")
def missing_items_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Grade ids in statements that no card has."""
    ids = read_table(spark, folder, "equivalences").select(F.col("source_grade_id").alias("grade_id")).where("grade_id is not null")
    return decision_log.unmatched_decisions(ids, read_table(spark, folder, "grade_cards"), "grade_id").distinct()


@_query("""WITH a AS (SELECT grade_id, count(*) AS sent FROM grade_cards GROUP BY 1), b AS (SELECT target_grade_id AS grade_id, count(*) AS got FROM equivalences WHERE target_grade_id IS NOT NULL GROUP BY 1)
  SELECT grade_id, CASE WHEN got IS NULL THEN 'MISSING' WHEN sent IS NULL THEN 'UNEXPECTED' ELSE 'DUPLICATE' END AS problem FROM a FULL JOIN b USING (grade_id)
  WHERE got IS NULL OR sent IS NULL OR got <> sent""")
def id_bag_check(spark: SparkSession, folder: str) -> DataFrame:
    got = read_table(spark, folder, "equivalences").select(F.col("target_grade_id").alias("grade_id")).where("grade_id is not null")
    return evidence.id_differences(read_table(spark, folder, "grade_cards"), got, "grade_id")


@_query("SELECT profile AS value, count(*) AS rows FROM offers GROUP BY profile")
def profile_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.histogram(read_table(spark, folder, "offers"), "profile")


@_query("""SELECT count(*) AS offers, count(price_rub_kg) AS priced, count(*) FILTER (price_rub_kg IS NULL) AS unpriced, count(*) FILTER (requires_review) AS in_review,
  CAST(sum(coalesce(len(review_reasons), 0)) AS BIGINT) AS reasons, count(DISTINCT supplier) AS suppliers FROM offers""")
def offer_stats(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.offer_stats(read_table(spark, folder, "offers"))


_TABLES = ("offers", "raw_items", "raw_lines", "grades", "aliases", "equivalences", "grade_cards", "documents")


@_query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _TABLES))
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.table_counts({t: read_table(spark, folder, t) for t in _TABLES})


@_query("""WITH p AS (SELECT a.grade IS NOT DISTINCT FROM b.grade AS g, a.profile IS NOT DISTINCT FROM b.profile AS f
    FROM (SELECT raw_description, min(profile) AS profile, min(grade) AS grade FROM offers GROUP BY 1) a JOIN (SELECT raw_description, max(profile) AS profile, max(grade) AS grade FROM offers GROUP BY 1) b USING (raw_description))
  SELECT 'grade' AS field, count(*) AS cases, count(*) FILTER (g) AS correct, round(count(*) FILTER (g) / count(*), 4) AS accuracy FROM p
  UNION ALL SELECT 'profile', count(*), count(*) FILTER (f), round(count(*) FILTER (f) / count(*), 4) FROM p""")
def field_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """How often the fields of equal descriptions agree."""
    by = read_table(spark, folder, "offers").groupBy("raw_description")
    least, most = (by.agg(f("profile").alias("profile"), f("grade").alias("grade")) for f in (F.min, F.max))
    return metrics.field_accuracy(least, most, "raw_description", ("grade", "profile"))


@_query("""WITH l AS (SELECT l_orderkey, CAST(round(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)), 2) AS DECIMAL(18,2)) AS amount FROM lineitem),
  s AS (SELECT l_orderkey AS o_orderkey, CAST(sum(amount) AS DECIMAL(18,2)) AS subtotal FROM l GROUP BY 1),
  b AS (SELECT o_orderkey, coalesce(subtotal, 0) AS subtotal, CAST(coalesce(subtotal, 0) - 5 + 10 AS DECIMAL(18,2)) AS base FROM orders LEFT JOIN s USING (o_orderkey))
  SELECT o_orderkey, subtotal, base, CAST(round(base * 20 / 100, 2) AS DECIMAL(18,2)) AS vat, CAST(base + CAST(round(base * 20 / 100, 2) AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total FROM b""")
def document_totals(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("unit_price"), F.lit(0).cast("decimal(5,2)").alias("markup_rate")
    )
    heads = read_table(spark, folder, "orders").select(
        "o_orderkey", F.lit(5).cast("decimal(18,2)").alias("discount"), F.lit(10).cast("decimal(18,2)").alias("delivery"), F.lit(20).cast("decimal(5,2)").alias("vat_rate"), F.lit(False).alias("prices_include_vat")
    )
    return documents.document_totals(lines, heads, "o_orderkey")


@_query("""WITH e AS (SELECT o_custkey AS document_key, CAST(o_orderkey AS VARCHAR) AS content_hash, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders WHERE o_orderdate < '1996-01-01'),
  n AS (SELECT DISTINCT o_custkey AS document_key, CAST(o_orderkey AS VARCHAR) AS content_hash FROM orders WHERE o_orderdate >= '1995-01-01'),
  t AS (SELECT document_key, max(v) AS top FROM e GROUP BY 1)
  SELECT document_key, content_hash, coalesce(v, coalesce(top, 0) + row_number() OVER (PARTITION BY document_key, v IS NULL ORDER BY content_hash)) AS version
  FROM n LEFT JOIN e USING (document_key, content_hash) LEFT JOIN t USING (document_key)""")
def document_version(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of each customer's orders since 1995, where those before 1996 are stored already."""
    orders = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("document_key"), F.col("o_orderkey").cast("string").alias("content_hash"), "o_orderkey", "o_orderdate")
    order = Window.partitionBy("document_key").orderBy("o_orderkey")
    stored = orders.where("o_orderdate < '1996-01-01'").withColumn("version", F.row_number().over(order).cast("long"))
    return documents.next_versions(stored, orders.where("o_orderdate >= '1995-01-01'"))


@_query(r"""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{000B}\x{0085}\x{2028}\x{2029}\x{1680}]+', ' ', 'g')) AS plain FROM documents""")
def normalize_space_text(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", text.squeeze_space(F.col("text")).alias("plain"))


@_query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def sha256_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return mail.first_of_each(read_table(spark, folder, "documents"), "text", "doc_id")


@_query(r"""SELECT term, count(*) AS documents FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(upper(text), '[0-9A-ZА-ЯЁ]+(?:[-_/][0-9A-ZА-ЯЁ]+)*'))) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term""")
def token_terms(spark: SparkSession, folder: str) -> DataFrame:
    """In how many documents each search term occurs."""
    terms = F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(search_mask.TERM), F.lit(0)))
    return read_table(spark, folder, "documents").where("text is not null").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


@_query("""SELECT line_id, last_value(NULLIF(trim(regexp_extract(raw_line, '^[^;"]*')), '') IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS supplier FROM raw_lines""")
def forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The last unquoted first field of a file's lines so far."""
    lines = read_table(spark, folder, "raw_lines").select("line_id", "source_file", "line_no", F.regexp_extract("raw_line", r'^[^;"]*', 0).alias("supplier"))
    lines = lines.withColumn("supplier", F.trim("supplier"))
    return fill_down(lines, "supplier", ["source_file"], "line_no").select("line_id", "supplier")


@_query("SELECT p_partkey, 0 AS block, p_name AS name, p_retailprice AS price FROM part UNION ALL SELECT p_partkey, 1, p_type, CAST(p_size AS DOUBLE) FROM part")
def stack_two_blocks(spark: SparkSession, folder: str) -> DataFrame:
    part = read_table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice", "p_type", F.col("p_size").cast("double").alias("p_size"))
    return stack_blocks(part, [["p_name", "p_retailprice"], ["p_type", "p_size"]], ["name", "price"]).select("p_partkey", "block", "name", "price")


@_query("SELECT item_id, json_extract_string(extra_json, '$.comments') AS comments, json_extract_string(extra_json, '$.profile_hint') AS profile_hint FROM raw_items")
def json_extra_extract(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "raw_items")
    return items.select("item_id", F.get_json_object("extra_json", "$.comments").alias("comments"), F.get_json_object("extra_json", "$.profile_hint").alias("profile_hint"))


@_query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS batch FROM documents")
def ordered_batches(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.in_batches(read_table(spark, folder, "documents").select("doc_id"), 10, "doc_id")


@_query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT l_orderkey FROM lineitem)")
def audit_anti_append(spark: SparkSession, folder: str) -> DataFrame:
    done = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("event_id"))
    return decision_log.append_new(done, read_table(spark, folder, "events").select("event_id"), "event_id")


@_query(r"""SELECT item_id, CASE WHEN profile_word <> '' THEN true ELSE false END AS named FROM (SELECT item_id, regexp_extract(lower(coalesce(description, '')), '(?:^|[^0-9a-zа-яё_])(труб|лист|плит|круг|прут|проволок|лент|полос|квадрат|шестигран|поковк|угол|швеллер|анод|катод|фольг|шин|гранул|втулк|диск|кольц|проводник|сетк|отвод|тройник|переход|флан|болт|винт|гайк|шайб|шпильк|электрод|заготовк|слит|шихт|лом)') AS profile_word FROM raw_items)""")
def profile_named(spark: SparkSession, folder: str) -> DataFrame:
    found = profiles.profile_of(F.col("description"))
    return read_table(spark, folder, "raw_items").select("item_id", found.isin(*profiles.PROFILE_STEMS).alias("named"))


@_query(r"""SELECT item_id, try_cast(nullif(regexp_extract(replace(regexp_replace(lower(price), 'руб\.?|₽|[''\x{2019}\s\x{00A0}\x{202F}]', '', 'g'), ',', '.'), '[-+]?[0-9]+(?:\.[0-9]+)?'), '') AS DECIMAL(18,4)) AS price FROM raw_items""")
def price_values(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "raw_items").select("item_id", dim.parse_price(F.col("price")).alias("price"))


@_query("SELECT offer_id, 'of-' || substr(sha256(concat_ws('|', source_file, source_sheet, CAST(source_row AS VARCHAR), source_block)), 1, 24) AS row_key FROM offers")
def provenance_ids(spark: SparkSession, folder: str) -> DataFrame:
    place = F.concat_ws("|", "source_file", "source_sheet", F.col("source_row").cast("string"), "source_block")
    return read_table(spark, folder, "offers").select("offer_id", stable_id("of", place).alias("row_key"))


@_query()
def parsed_items(spark: SparkSession, folder: str) -> DataFrame:
    """Raw items as normalised rows."""
    return parse_items(read_table(spark, folder, "raw_items"))


@_query("""SELECT source_file AS file, CASE WHEN length(source_file) % 2 = 0 THEN 1 ELSE 2 END AS row_no, 1 AS description, 2 AS availability, 3 AS price_vat, 4 AS grade_hint, 5 AS mapped FROM (SELECT DISTINCT source_file FROM raw_lines)""")
def header_detection(spark: SparkSession, folder: str) -> DataFrame:
    """The files of delimited lines as sheets, each with a header above its lines and, in
    every other file, a title above that."""
    found = detect_headers(_sheets_of_lines(spark, folder))
    columns = [F.col("mapping")[f].alias(f) for f in ("description", "availability", "price_vat", "grade_hint")]
    return found.select("file", "row_no", *columns, F.size("mapping").alias("mapped"))


_HEADINGS = ("Поставщик", "Наименование товара", "Остаток, склад", "Цена с НДС, руб/кг", "Марка сплава", "Длина, вес нетто")


def _sheets_of_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the files of delimited lines with a header row and some titles above it."""
    lines = read_table(spark, folder, "raw_lines").select(F.col("source_file").alias("file"), F.col("line_no").cast("int").alias("line_no"), split_line(F.col("raw_line"))["cells"].alias("c"))
    above = F.when(F.length("file") % 2 == 0, 1).otherwise(2)
    cell = lambda v: F.struct(v.alias("v"), F.lit(False).alias("is_num"))
    body = lines.select("file", (F.col("line_no") + above).alias("row_no"), F.transform("c", cell).alias("cells"))
    files = lines.select("file").distinct()
    heads = files.select("file", above.alias("row_no"), F.array(*[cell(F.lit(h)) for h in _HEADINGS]).alias("cells"))
    titles = files.where(F.length("file") % 2 == 1).select("file", F.lit(1).alias("row_no"), F.array(cell(F.lit("Прайс-лист"))).alias("cells"))
    whole = body.unionByName(heads).unionByName(titles)
    return whole.select("file", F.lit("lines").alias("sheet"), F.lit(0).alias("sheet_ix"), "row_no", "cells")


_NAMES = "(SELECT min(grade_id) AS name_id, k FROM (SELECT grade_id, {0} AS k FROM grades UNION ALL SELECT canonical_grade_id, {1} FROM aliases WHERE status <> 'REJECTED') WHERE k <> '' GROUP BY k)".format(
    _KEY.format("canonical"), _KEY.format("alias")
)


@_query(
    rf"""WITH w AS (SELECT offer_id, list_filter(string_split_regex(translate(upper(raw_description), 'АВЕКМНОРСТУХЁ', 'ABEKMHOPCTYXE'), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '') AS w FROM offers WHERE raw_description IS NOT NULL),
  p AS (SELECT offer_id, pos, n AS words, array_to_string(w[pos:pos + n - 1], '') AS k FROM (SELECT offer_id, w, unnest(range(1, len(w) + 1)) AS pos FROM w), (VALUES (1), (2), (3)) t(n) WHERE pos + n - 1 <= len(w)),
  m AS (SELECT DISTINCT offer_id, pos, words, name_id FROM p JOIN {_NAMES} USING (k))
  SELECT offer_id, pos, CAST(words AS BIGINT) AS words, name_id FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.offer_id = a.offer_id AND b.pos < a.pos + a.words AND a.pos < b.pos + b.words
    AND (b.words > a.words OR (b.words = a.words AND b.pos < a.pos)))"""
)
def names_in_text(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue names inside the descriptions of offers."""
    names = catalog.names_of_grades(read_table(spark, folder, "grades"), read_table(spark, folder, "aliases")).withColumnRenamed("grade_id", "name_id")
    return find_names(read_table(spark, folder, "offers"), "offer_id", "raw_description", names)


@_query("""SELECT offer_id, concat_ws(' ', array_to_string(list_transform(string_split(lower(profile), ' '), lambda w: upper(w[1]) || w[2:]), ' '), grade) AS shown FROM offers""")
def display_names(spark: SparkSession, folder: str) -> DataFrame:
    shown = attributes.display_name(F.col("profile"), F.col("grade"), F.lit(None).cast("string"))
    return read_table(spark, folder, "offers").select("offer_id", shown.alias("shown"))


@_query("""WITH n AS (SELECT offer_id, profile, (dim1 IS NOT NULL)::INT + (dim2 IS NOT NULL)::INT AS a, (dim3 IS NOT NULL)::INT AS b FROM offers)
  SELECT offer_id, CASE WHEN profile IN ('КРУГ', 'ПРОВОЛОКА', 'ШЕСТИГРАННИК', 'ПРУТОК') THEN least(a, 1) + least(b, 1) WHEN profile = 'ТРУБА' THEN least(a, 2) + least(b, 1) ELSE least(a + b, 3) END AS sizes FROM n""")
def structured_columns(spark: SparkSession, folder: str) -> DataFrame:
    """How many sizes come out of two columns of sizes."""
    sizes = attributes.structured_sizes(F.col("profile"), F.concat_ws("x", F.col("dim1").cast("string"), F.col("dim2").cast("string")), F.col("dim3").cast("string"))
    return read_table(spark, folder, "offers").select("offer_id", F.size(sizes).alias("sizes"))


@_query("""SELECT offer_id, list_has(review_reasons, 'business_rule_pending') OR list_has(review_reasons, 'grade_conflict') AS normalisation, coalesce(len(review_reasons), 0) > 0 AS any_reason FROM offers WHERE requires_review""")
def review_queues(spark: SparkSession, folder: str) -> DataFrame:
    """Offers in review, and whether they belong to the queue of conflicting rows; queues overlap."""
    return decision_log.review_queues(read_table(spark, folder, "offers")).select("offer_id", "normalisation", "any_reason")


@_query("""SELECT source_file, bool_and(coalesce(step >= 0, true)) AS in_order FROM (SELECT source_file, line_no - lag(line_no) OVER (PARTITION BY source_file ORDER BY line_id) AS step FROM raw_lines) GROUP BY source_file""")
def order_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the lines of each file are numbered in the order of their ids."""
    return metrics.in_order(read_table(spark, folder, "raw_lines"), "source_file", "line_no", "line_id")


@_query()
def price_lists_by_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Files of delimited lines as sheets, read by layout, header or as bare rows."""
    return read_price_lists(_sheets_of_lines(spark, folder))


@_query("""WITH r AS (SELECT offer_id, requires_review, confidence, CASE WHEN grade = 'предпол.' AND NOT list_has(list_distinct(coalesce(review_reasons, [])), 'unconfirmed_grade') THEN len(list_distinct(coalesce(review_reasons, []))) + 1
    ELSE len(list_distinct(coalesce(review_reasons, []))) END AS n FROM offers)
  SELECT offer_id, CASE WHEN n = 0 THEN 1 ELSE n END AS reasons FROM r WHERE n > 0 OR requires_review OR confidence < 0.9""")
def candidate_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Offers for a second look, with the number of their reasons."""
    return candidates(read_table(spark, folder, "offers")).select("offer_id", F.size("reasons").cast("long").alias("reasons"))


@_query("""SELECT offer_id, concat_ws(' / ', source_file, source_sheet, 'строка ' || source_row, source_block) AS source FROM offers""")
def source_texts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "offers").select("offer_id", source_text().alias("source"))


@_query("""SELECT offer_id, CAST(to_json({'source_id': offer_id, 'supplier': supplier, 'description': raw_description, 'current_profile': profile, 'current_grade': grade,
  'current_dimensions': [CAST(dim1 AS VARCHAR), CAST(dim2 AS VARCHAR), CAST(dim3 AS VARCHAR)], 'requires_review': requires_review, 'review_reasons': review_reasons}) AS VARCHAR) AS payload FROM offers WHERE requires_review""")
def review_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """What a reviewer or model is shown of each offer in review."""
    return payload(read_table(spark, folder, "offers").where("requires_review"))


@_query(r"""SELECT item_id, len(regexp_extract_all(' ' || coalesce(description, ''), '[^0-9A-Za-zА-Яа-яЁё.,/-][0-9]+(?:[.,][0-9]+)?(?:\s*[xхXХ×*]\s*[0-9]+(?:[.,][0-9]+)?){1,3}(?:\s*(?:мм|см|м|mm|cm|m))?(?:[^0-9A-Za-zА-Яа-яЁё]|$)')) > 0 AS written FROM raw_items""")
def size_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a description holds a sequence of sizes."""
    return read_table(spark, folder, "raw_items").select("item_id", (F.size(size_text.size_sequences(F.col("description"))) > 0).alias("written"))


@_query()
def stated_grades(spark: SparkSession, folder: str) -> DataFrame:
    """The grade that each raw description states, and the rule that found it."""
    items = read_table(spark, folder, "raw_items").select("item_id", "description", profiles.profile_of(F.col("description")).alias("profile"))
    return grades_in_text(items, "item_id", "description", "profile", read_table(spark, folder, "grades"), read_table(spark, folder, "aliases"))


_FULL_KEY = rf"regexp_replace(translate(upper(trim(regexp_replace(grade, '\s+', ' ', 'g'), ' [];,')), 'АВЕКМНОРСТУХЁ', 'ABEKMHOPCTYXE'), '[^\p{{L}}\p{{Nd}}]+', '', 'g')"


@_query(
    f"""WITH n AS (SELECT {_KEY.format("name")} AS k, canonical FROM (SELECT canonical AS name, canonical FROM grades UNION ALL SELECT alias, canonical FROM aliases JOIN grades ON canonical_grade_id = grade_id WHERE aliases.status <> 'REJECTED') WHERE name IS NOT NULL AND canonical IS NOT NULL),
  one AS (SELECT k, min(canonical) AS known FROM n WHERE k <> '' GROUP BY k HAVING count(DISTINCT canonical) = 1)
  SELECT offer_id, CASE WHEN trim(coalesce(grade, ''), ' [];,') = '' THEN 'предпол.' ELSE coalesce(known, replace(upper(trim(trim(regexp_replace(grade, '\s+', ' ', 'g'), ' [];,'), '()')), 'Ё', 'Е')) END AS grade FROM offers LEFT JOIN one ON {_FULL_KEY} = k"""
)
def typed_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Grades of offers as the catalogue spells them."""
    names = known_names(read_table(spark, folder, "grades"), read_table(spark, folder, "aliases"))
    return normalise_grades(read_table(spark, folder, "offers").select("offer_id", F.col("grade").alias("typed")), "typed", names).select("offer_id", "grade")


@_query("""SELECT 'parsed-' || CASE WHEN length(n) < 6 THEN lpad(n, 6, '0') ELSE n END AS id, offer_id FROM (SELECT offer_id,
  CAST(row_number() OVER (ORDER BY source_file NULLS FIRST, source_sheet NULLS FIRST, source_row NULLS FIRST, source_block NULLS FIRST, offer_id) AS VARCHAR) AS n FROM offers)""")
def searchable_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Offers with an id by their place in the sources."""
    order = ("source_file", "source_sheet", "source_row", "source_block", "offer_id")
    return metrics.positional_ids(read_table(spark, folder, "offers").select(*order), "parsed", 6, *order).select("id", "offer_id")


@_query("""SELECT offer_id, shown_profile, CASE WHEN shown_profile = profile THEN comment_text ELSE concat_ws('; ', NULLIF(comment_text, ''), 'Поисковый синоним профиля: ' || shown_profile || '; исходный профиль поставщика: ' || profile || '; не отдельная складская позиция') END AS comment_text
  FROM offers, (VALUES ('КРУГ'), ('ПРУТОК')) t(shown_profile) WHERE profile IN ('КРУГ', 'ПРУТОК')""")
def rows_to_show(spark: SparkSession, folder: str) -> DataFrame:
    """What an export shows of a search for round bars."""
    return listing.rows_to_show(read_table(spark, folder, "offers"), profiles.ROUND_BARS).select("offer_id", "shown_profile", "comment_text")


@_query("""SELECT item_id, CASE WHEN regexp_full_match(a, '-?[0-9]+(?:[.,][0-9]+)?') AND coalesce(u, '') <> '' THEN replace(a, ',', '.') || ' ' || u ELSE a END AS availability
  FROM (SELECT item_id, trim(regexp_replace(coalesce(availability, ''), '[\\s\\x{00A0}\\x{202F}\\x{2009}]+', ' ', 'g')) AS a, json_extract_string(extra_json, '$.availability_unit') AS u FROM raw_items)""")
def availability_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts as shown, with the unit of their column."""
    shown = values.availability_text(F.col("availability"), F.get_json_object("extra_json", "$.availability_unit"))
    return read_table(spark, folder, "raw_items").select("item_id", shown.alias("availability"))


@_query()
def stated_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The sizes that each raw description states, and the rule that found them."""
    items = read_table(spark, folder, "raw_items").select("item_id", "description", profiles.profile_of(F.col("description")).alias("profile"), "grade_hint")
    return sizes_in_text(items, "item_id", "description", "profile", "grade_hint")
