"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sortament.llm.canonical_values import match_grades
from sortament.llm.components import grade_groups
from sortament.llm.eval_leaks import leak_matches, leaked_items
from sortament.llm.format_duplicates import offer_duplicates
from sortament.llm.mixing import Mixture, mix, mixture_copies, mixture_report
from sortament.llm.product_groups import product_groups, product_pairs
from sortament.llm.spam_pages import score_pages, spam_pages
from sortament.tables import read_table


def _offers_and_list(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [read_table(spark, folder, t) for t in ("offers", "grades", "aliases")]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of offers of the same product."""
    return product_pairs(*_offers_and_list(spark, folder))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each offer with its product's group and the number of its links."""
    return product_groups(*_offers_and_list(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each linked grade record with the smallest record of its whole group."""
    return grade_groups(read_table(spark, folder, "equivalences"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Grades as typed to the canonical list."""
    return match_grades(*_offers_and_list(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Offers that differ at most in how they are written."""
    return offer_duplicates(read_table(spark, folder, "offers"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Test items and the documents that share a run of words with them."""
    return leaked_items(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p8_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the longest phrase and all words found in place."""
    return leak_matches(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def _mixture(spark: SparkSession, folder: str) -> Mixture:
    return mix(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached share of each source."""
    return mixture_report(_mixture(spark, folder))


def p9_copies(spark: SparkSession, folder: str) -> DataFrame:
    """The documents used, with their copies."""
    return mixture_copies(_mixture(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of keywords, links or tags instead of sentences."""
    return spam_pages(read_table(spark, folder, "documents"))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The measures of every document."""
    return score_pages(read_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p6_found, p7_found, p8_found, p8_matches, p9_copies, p9_report, p10_found, p10_scores)}

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

SQL = {
    "p8_found": rf"""WITH i AS (SELECT item_id, {_WORDS.format('passage')} AS w FROM eval_items),
    d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
    ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
    dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
    SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (g)""",
    "p2_found": """WITH RECURSIVE edges AS (
      SELECT DISTINCT source_grade_id AS a, target_grade_id AS b FROM equivalences
      WHERE source_grade_id IS NOT NULL AND target_grade_id IS NOT NULL AND source_grade_id <> target_grade_id
        AND upper(trim(relation_type)) = 'EQUIVALENT' AND coalesce(status <> 'REJECTED', true)),
    links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    reach(v, w) AS (SELECT a, a FROM links UNION SELECT r.v, e.b FROM reach r JOIN links e ON r.w = e.a)
    SELECT v AS grade_id, min(w) AS group_id FROM reach GROUP BY v""",
    "p6_found": r"""WITH entries AS (SELECT grade_id, canonical AS name, 0 AS rank FROM grades UNION ALL SELECT canonical_grade_id, alias, 1 FROM aliases),
    known AS (SELECT regexp_replace(translate(upper(regexp_replace(name, '(?i)^[\s\p{P}]*(?:материал|сплав|сталь|марка|металл|мат|ст|гр)(?:\s*\.\s*|\s+)(\S)', '\1')), 'АВЕКМНОРСТУХЁБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯ', 'ABEKMHOPCTYXEbgdjziqlpfwvhymtnaus'), '[^\p{L}\p{Nd}]+', '', 'g') AS token, min(rank) AS rank, arg_min(grade_id, (rank, grade_id)) AS grade_id FROM entries WHERE name IS NOT NULL GROUP BY 1),
    typed AS (SELECT DISTINCT grade FROM offers WHERE trim(coalesce(grade, '')) NOT IN ('', 'предпол.') AND grade NOT IN (SELECT canonical FROM grades)),
    tokens AS (SELECT grade, regexp_replace(translate(upper(regexp_replace(grade, '(?i)^[\s\p{P}]*(?:материал|сплав|сталь|марка|металл|мат|ст|гр)(?:\s*\.\s*|\s+)(\S)', '\1')), 'АВЕКМНОРСТУХЁБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯ', 'ABEKMHOPCTYXEbgdjziqlpfwvhymtnaus'), '[^\p{L}\p{Nd}]+', '', 'g') AS token FROM typed UNION SELECT grade, regexp_replace(translate(upper(grade), 'АВЕКМНОРСТУХЁБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯ', 'ABEKMHOPCTYXEbgdjziqlpfwvhymtnaus'), '[^\p{L}\p{Nd}]+', '', 'g') FROM typed),
    near AS (SELECT grade, k.grade_id, levenshtein(t.token, k.token) AS edits, rank FROM tokens t JOIN known k ON abs(length(t.token) - length(k.token)) <= 2),
    best AS (SELECT grade, arg_min(grade_id, (edits, rank, grade_id)) AS grade_id FROM near WHERE edits <= 2 GROUP BY grade)
    SELECT offer_id, coalesce(b.grade_id, 'UNMATCHED') AS grade_id FROM offers o JOIN typed USING (grade) LEFT JOIN best b USING (grade)""",
    "p7_found": r"""WITH cut AS (
      SELECT offer_id, price_rub_kg AS p,
        regexp_replace(regexp_replace(lower(coalesce(raw_description, '')), '([0-9])[.,]([0-9])', '\1_\2', 'g'), '([0-9])[.,]([0-9])', '\1_\2', 'g') AS d,
        regexp_replace(regexp_replace(lower(coalesce(supplier, '')), '([0-9])[.,]([0-9])', '\1_\2', 'g'), '([0-9])[.,]([0-9])', '\1_\2', 'g') AS s
      FROM offers WHERE price_rub_kg IS NOT NULL),
    keyed AS (SELECT offer_id, p, list_sort(regexp_extract_all(d, '[\p{L}\p{M}\p{N}_]+')) AS d, list_sort(regexp_extract_all(s, '[\p{L}\p{M}\p{N}_]+')) AS s FROM cut)
    SELECT offer_id, min(offer_id) OVER w AS first_offer_id, count(*) OVER w AS copies FROM keyed
    WINDOW w AS (PARTITION BY p, d, s) QUALIFY count(*) OVER w > 1""",
}


def queries() -> dict:
    """name -> query."""
    return QUERIES


def oracle_sql() -> dict[str, str]:
    """name -> SQL that gives the same rows."""
    return SQL
