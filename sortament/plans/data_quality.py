"""Queries of the general problems: rows that fail, packed fields, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortament.operators.reject_rows import load_lines, reject_counts
from sortament.operators.split_fields import split_positions
from sortament.operators.units import common_units
from sortament.tables import read_table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Bad lines with the first reason that applies."""
    return load_lines(read_table(spark, folder, "raw_lines"), "line_id", "raw_line").rejected


def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Good lines, loaded into typed columns."""
    return load_lines(read_table(spark, folder, "raw_lines"), "line_id", "raw_line").loaded


def p3_parse_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Loaded and skipped lines of each file, in place of what an earlier loader reported."""
    lines = read_table(spark, folder, "raw_lines")
    return reject_counts(lines, load_lines(lines, "line_id", "raw_line").rejected, "line_id", "source_file")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of fields that hold several."""
    return split_positions(read_table(spark, folder, "offers"), read_table(spark, folder, "raw_items"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stock and first size in common units."""
    return common_units(read_table(spark, folder, "offers"), read_table(spark, folder, "raw_items")).select(
        "src", "row_id", "measure", "base_unit", F.col("base_value")
    )


QUERIES = {f.__name__: f for f in (p3_found, p3_loaded, p3_parse_stats, p4_found, p5_found)}

# RE2 has neither look-around nor possessive repeats; these say the same in its terms.
_CUT = r"""
cut AS (
  SELECT line_id, source_file,
    regexp_full_match(coalesce(raw_line, ''), '(?:"(?:[^"]|"")*"|[^";\r\n]*)(?:;(?:"(?:[^"]|"")*"|[^";\r\n]*))*') AS ok,
    regexp_extract_all(';' || coalesce(raw_line, ''), ';(?:"(?:[^"]|"")*"|[^";\r\n]*)') AS parts
  FROM raw_lines
),
cells AS (
  SELECT line_id, source_file, ok, list_transform(parts, lambda x: CASE WHEN x LIKE ';"%' THEN replace(x[3:-2], '""', '"') ELSE x[2:] END) AS c FROM cut
),
checked AS (
  SELECT line_id, source_file, c, CASE
    WHEN NOT ok THEN 'broken_quoting'
    WHEN len(c) <> 6 THEN 'column_count'
    WHEN NOT regexp_matches(c[2], '\p{L}') OR contains(c[2], chr(65533)) THEN 'invalid_value'
    WHEN regexp_matches(c[4], '[^\s\x{00A0}\x{202F}]') AND NOT coalesce(try_cast(CASE WHEN regexp_full_match(
      regexp_replace(regexp_replace(c[4], '[\s\x{00A0}\x{202F}]*(?:руб\.?|р\.|₽)?[\s\x{00A0}\x{202F}]*$', ''), '[ \x{00A0}\x{202F}'']', '', 'g'), '[0-9]+(?:[.,][0-9]{1,4})?')
      THEN replace(regexp_replace(regexp_replace(c[4], '[\s\x{00A0}\x{202F}]*(?:руб\.?|р\.|₽)?[\s\x{00A0}\x{202F}]*$', ''), '[ \x{00A0}\x{202F}'']', '', 'g'), ',', '.') END AS DECIMAL(18,4)) BETWEEN 0.0001 AND 9999999.9999, false) THEN 'invalid_value'
    WHEN regexp_matches(c[6], '[^\s\x{00A0}]') AND try_cast(CASE
      WHEN regexp_full_match(trim(c[6]), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN trim(c[6])
      WHEN regexp_full_match(trim(c[6]), '[0-9]{2}\.[0-9]{2}\.[0-9]{4}') THEN trim(c[6])[7:10] || '-' || trim(c[6])[4:5] || '-' || trim(c[6])[1:2] END AS DATE) IS NULL THEN 'invalid_value'
  END AS reason FROM cells
)"""

_NUMBER = r"""(?:[0-9]{1,3}(?:[ \x{00A0}\x{202F}''\x{2019}][0-9]{3})+|[0-9]+)(?:[.,][0-9]+)?"""
_UNITS = r"(?:тыс\.? ?штук|тыс\.? ?шт|килограмм|центнеров|фунтов|грамм|метров|футов|пог\.? ?м|п\.? ?м|тонн|штук|фунт|фут|inch|дюйм|pcs|lbs|кг|kg|тн|гр|км|km|см|cm|мм|mm|шт|ft|lb|in|т|t|ц|г|g|м|m)"

SQL = {
    "p3_found": f"WITH {_CUT} SELECT line_id, reason FROM checked WHERE reason IS NOT NULL",
    "p3_loaded": f"""WITH {_CUT} SELECT line_id, c[1] AS supplier, c[2] AS description, c[3] AS availability,
      try_cast(replace(regexp_replace(regexp_replace(c[4], '[\\s\\x{{00A0}}\\x{{202F}}]*(?:руб\\.?|р\\.|₽)?[\\s\\x{{00A0}}\\x{{202F}}]*$', ''), '[ \\x{{00A0}}\\x{{202F}}'']', '', 'g'), ',', '.') AS DECIMAL(18,4)) AS price, c[5] AS grade_hint,
      try_cast(CASE WHEN trim(c[6]) LIKE '____-__-__' THEN trim(c[6]) WHEN trim(c[6]) LIKE '__.__.____' THEN trim(c[6])[7:10] || '-' || trim(c[6])[4:5] || '-' || trim(c[6])[1:2] END AS DATE) AS price_date
      FROM checked WHERE reason IS NULL""",
    "p3_parse_stats": f"""WITH {_CUT} SELECT source_file, count(*) AS lines, count(*) FILTER (reason IS NULL) AS loaded, count(reason) AS skipped_rows,
      count(*) FILTER (reason = 'broken_quoting') AS broken_quoting, count(*) FILTER (reason = 'column_count') AS column_count,
      count(*) FILTER (reason = 'invalid_value') AS invalid_value FROM checked GROUP BY source_file""",
    "p5_found": rf"""WITH units(spelling, base_unit, factor) AS (VALUES
      ('т','g',1000000.0),('тн','g',1000000.0),('тонн','g',1000000.0),('t','g',1000000.0),('ц','g',100000.0),('центнеров','g',100000.0),
      ('кг','g',1000.0),('kg','g',1000.0),('килограмм','g',1000.0),('г','g',1.0),('гр','g',1.0),('грамм','g',1.0),('g','g',1.0),
      ('lb','g',453.59237),('lbs','g',453.59237),('фунт','g',453.59237),('фунтов','g',453.59237),
      ('км','mm',1000000.0),('km','mm',1000000.0),('м','mm',1000.0),('m','mm',1000.0),('метров','mm',1000.0),('пм','mm',1000.0),('погм','mm',1000.0),
      ('см','mm',10.0),('cm','mm',10.0),('мм','mm',1.0),('mm','mm',1.0),('ft','mm',304.8),('фут','mm',304.8),('футов','mm',304.8),
      ('in','mm',25.4),('inch','mm',25.4),('дюйм','mm',25.4),
      ('тысшт','pcs',1000.0),('тысштук','pcs',1000.0),('шт','pcs',1.0),('штук','pcs',1.0),('pcs','pcs',1.0)),
    texts AS (
      SELECT 'offers' AS src, offer_id AS row_id, availability AS a, quantity_value AS v, regexp_replace(lower(quantity_unit), '[.\s]+', '', 'g') AS u FROM offers
      UNION ALL SELECT 'raw_items', item_id, availability, NULL, json_extract_string(extra_json, '$.availability_unit') FROM raw_items),
    found AS (
      SELECT *, regexp_extract(lower(a), '(?:^|[^\p{{L}}\p{{N}}.,])({_NUMBER})\s*({_UNITS})(?:[^\p{{L}}]|$)', ['n', 'u']) AS x,
        regexp_extract(lower(a), '(?:^|[^\p{{L}}])({_UNITS})\.?\s*[:)—–-]\s*({_NUMBER})(?:[^\p{{L}}\p{{N}}]|$)', ['u', 'n']) AS y,
        regexp_extract(lower(a), '^\s*(?:≈|~|ок\.?)?\s*({_NUMBER})\s*$', 1) AS z FROM texts),
    stated AS (
      SELECT src, row_id, CASE WHEN src = 'offers' AND v IS NOT NULL AND coalesce(u, '') <> '' THEN v ELSE
          try_cast(replace(regexp_replace(CASE WHEN x.n <> '' THEN x.n WHEN y.n <> '' THEN y.n WHEN src = 'raw_items' AND u IS NOT NULL THEN z ELSE '' END, '[ \x{{00A0}}\x{{202F}}''\x{{2019}}]', '', 'g'), ',', '.') AS DECIMAL(18,6)) END AS amount,
        regexp_replace(CASE WHEN src = 'offers' AND v IS NOT NULL AND coalesce(u, '') <> '' THEN u WHEN x.n <> '' THEN x.u WHEN y.n <> '' THEN y.u WHEN src = 'raw_items' THEN lower(u) END, '[.\s]+', '', 'g') AS unit FROM found)
    SELECT src, row_id, 'quantity' AS measure, base_unit, CAST(round(CAST(amount AS DECIMAL(24,6)) * CAST(factor AS DECIMAL(12,5)), 0) AS BIGINT) AS base_value FROM stated JOIN units ON unit = spelling WHERE amount IS NOT NULL
    UNION ALL
    SELECT 'offers', offer_id, 'dim1', 'um', CAST(round(CAST(dim1 AS DECIMAL(24,6)) * CAST(factor * 1000 AS DECIMAL(12,5)), 0) AS BIGINT)
    FROM offers JOIN units ON regexp_replace(lower(dim1_unit), '[.\s]+', '', 'g') = spelling AND base_unit = 'mm' WHERE dim1 IS NOT NULL""",
}
