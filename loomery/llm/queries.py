"""Queries of the training-data operators over the project's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.canonical import map_rows
from loomery.llm.encoding import encode_corpus
from loomery.llm.frequency import mark_terms, term_counts
from loomery.llm.leak import leaked_items
from loomery.llm.lines import repeated_lines, without_repeated
from loomery.llm.neardup import NearDuplicates
from loomery.llm.splitting import split_oversized
from loomery.llm.stuffing import stuffed_pages
from loomery.sources.tables import table


def _typed_places(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "job_locations").select(F.lit("job_locations").alias("tbl"), F.col("location_id").alias("row_id"), F.col("raw_location").alias("value"))
    hits = table(spark, folder, "hits").select(F.lit("hits").alias("tbl"), F.col("hit_id").alias("row_id"), F.col("location").alias("value"))
    return jobs.unionAll(hits)


def _p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return map_rows(_typed_places(spark, folder), table(spark, folder, "places")).select("tbl", "row_id", "place_id")


def _p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    mapped = map_rows(_typed_places(spark, folder), table(spark, folder, "places"))
    return mapped.where("place_id = 0").groupBy("value").agg(F.count(F.lit(1)).alias("rows"))


def _p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines(table(spark, folder, "hits"))


def _p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeated(table(spark, folder, "hits"))


def _p2_near(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines(table(spark, folder, "hits"), near=True)


def _p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return NearDuplicates(table(spark, folder, "hits")).pairs()


def _p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return NearDuplicates(table(spark, folder, "hits")).groups()


def _p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "hits"))


def _p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p4_pieces(spark, folder).where("piece_no = 0 AND pieces > 1").select("hit_id")


def _p4_section_pieces(spark: SparkSession, folder: str) -> DataFrame:
    pieces = _p4_pieces(spark, folder)
    return pieces.groupBy("section").agg(F.count_if(F.col("piece_no") == 0).alias("texts"), F.sum(F.length("text") - F.when(F.col("piece_no") > 0, 200).otherwise(0)).alias("chars"))


def _p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "market_signals")
    counts = term_counts(rows, "term", "report_id", "postings", ["kind", "total", "core_in", "analyzed_at"])
    return mark_terms(counts, rows, "report_id").select("term", "occurrences", F.col("weight").alias("postings"), F.col("records").alias("reports"), F.array_join("marks", ",").alias("marks"))


def _p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p5_terms(spark, folder).where("marks <> ''").select("term", F.explode(F.split("marks", ",")).alias("mark"))


def _p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def _p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "questions"))


def _p8_pages(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages(table(spark, folder, "documents"))


def _p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p8_pages(spark, folder).where("stuffed").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _p1_found,
        "p1_unmatched": _p1_unmatched,
        "p2_found": _p2_found,
        "p2_clean": _p2_clean,
        "p2_near": _p2_near,
        "p3_found": _p3_found,
        "p3_groups": _p3_groups,
        "p4_found": _p4_found,
        "p4_pieces": _p4_pieces,
        "p4_section_pieces": _p4_section_pieces,
        "p5_found": _p5_found,
        "p5_terms": _p5_terms,
        "p6_ids": _p6_ids,
        "p7_found": _p7_found,
        "p8_found": _p8_found,
        "p8_pages": _p8_pages,
    }


_TERMS = r"""
WITH once AS (
  SELECT DISTINCT report_id, kind, term, postings, total, core_in, analyzed_at FROM market_signals
), folded AS (
  SELECT *, trim(regexp_replace(lower(term), '[ \t\-_]+', ' ', 'g'), ' ') AS folded FROM once
), counted AS (
  SELECT folded AS term, count(*)::BIGINT AS occurrences, coalesce(sum(postings), 0)::BIGINT AS postings,
         count(DISTINCT report_id)::BIGINT AS reports
  FROM folded WHERE folded <> '' GROUP BY folded
), marked AS (
  SELECT *, postings < 5 AS rare, reports > 0.2 * (SELECT count(DISTINCT report_id) FROM market_signals) AS common FROM counted
)
"""


_LINES = r"""
WITH kept AS (
  SELECT hit_id, lower(trim(company)) AS source, string_split(text, chr(10)) AS lines
  FROM hits WHERE regexp_matches(text, '[^\s\p{Z}]') AND regexp_matches(company, '[^\s\p{Z}]')
), placed AS (
  SELECT hit_id, source, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS line FROM kept
), lettered AS (
  SELECT hit_id, source, line_no, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS letters FROM placed
), sizes AS (
  SELECT source, count(*) AS texts FROM kept GROUP BY source
), counted AS (
  SELECT source, letters, count(DISTINCT hit_id) AS n FROM lettered WHERE letters <> '' GROUP BY source, letters
), hot AS (
  SELECT source, letters FROM counted JOIN sizes USING (source) WHERE n >= 5 AND n / texts >= 0.1
), found AS (
  SELECT hit_id, line_no::INTEGER AS line_no FROM lettered JOIN hot USING (source, letters)
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _LINES + "SELECT * FROM found",
        "p2_clean": _LINES + """, dropped AS (SELECT hit_id, list(line_no) AS nos FROM found GROUP BY hit_id)
            SELECT hit_id, CASE WHEN nos IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(nos, i)), chr(10)) END AS text
            FROM hits LEFT JOIN dropped USING (hit_id)""",
        "p4_found": "SELECT hit_id FROM hits WHERE length(text) > 1600",
        "p4_section_pieces": "SELECT section, count(*)::BIGINT AS texts, sum(length(text))::BIGINT AS chars FROM hits WHERE length(text) > 1600 GROUP BY section",
        "p5_terms": _TERMS + "SELECT term, occurrences, postings, reports, concat_ws(',', CASE WHEN rare THEN 'rare' END, CASE WHEN common THEN 'common' END) AS marks FROM marked",
        "p5_found": _TERMS + "SELECT term, 'rare' AS mark FROM marked WHERE rare UNION ALL SELECT term, 'common' FROM marked WHERE common",
    }
