"""All named queries of the engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions.text import citation_label
from loomery.operators.chunk import chunk
from loomery.operators.retrieve import TOP, Bm25
from loomery.plans import cleaning, matching, measures, search
from loomery.sources.tables import table

_ALL = cleaning.QUERIES | search.QUERIES | matching.QUERIES | measures.QUERIES


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The best chunks of the documents for each question, with scores and citation labels."""
    chunks = chunk(table(spark, folder, "documents"), "section", carry=("source", "title"))
    questions = table(spark, folder, "questions").select(F.col("id").alias("qid"), "question")
    found = Bm25(chunks, key="id").search(questions, TOP)
    label = citation_label(F.col("source"), F.col("title"), F.col("section"))
    return found.join(chunks.select("id", "doc_id", label.alias("citation")), "id").select("qid", "rank", "id", "doc_id", "score", "citation")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
