"""Readers and writers of corpora, questions and indexes."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTING = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "company", "title", "location", "posted_date", "url", "compensation", "geo_country", "geo_state", "geo_city", "work_mode", "remote_scope", "geo_confidence", "text")])
QUESTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("question", T.StringType()),
    T.StructField("expect_terms", T.ArrayType(T.StringType())), T.StructField("should_refuse", T.BooleanType()), T.StructField("why", T.StringType()),
])


def read_corpus(spark: SparkSession, path: str, schema: T.StructType = POSTING) -> DataFrame:
    """JSON Lines with a declared schema: nothing is inferred, blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_corpus(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_corpus(spark, path, QUESTION)


def write_index(chunks: DataFrame, path: str, most: int = 200_000) -> None:
    """An index of chunks, one folder a strategy, files of bounded size; strategies not written now are kept."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", most).partitionBy("strategy").parquet(path)


def read_index(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    """The index, or one strategy of it, by partition pruning."""
    index = spark.read.parquet(path)
    return index if strategy is None else index.where(F.col("strategy") == strategy)


def vectors_of(index: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows of an index by a table of keys."""
    return index.join(keys.select(key).distinct(), key, "left_semi")


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word file, then its table rows with cells parted by ' | '; empty lines are dropped."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        body = ElementTree.fromstring(file.read("word/document.xml")).find(f"{space}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{space}t"))
    lines = [said(p) for p in body.findall(f"{space}p")]
    for row in body.iter(f"{space}tr"):
        lines.append(" | ".join(cell for c in row.findall(f"{space}tc") if (cell := said(c).strip())))
    return "\n".join(line for line in lines if re.search(r"\S", line))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path and text of Word files."""

    @F.pandas_udf("string")
    def parse(values: pd.Series) -> pd.Series:
        return values.map(docx_text)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", parse("content").alias("text"))
