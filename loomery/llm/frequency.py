"""Frequency of every distinct term over the collection, with last-seen counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_term(term: Column) -> Column:
    """Lower case, each run of spaces, tabs, hyphens and underscores as one space, outer spaces removed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(term), r"[ \t\-_]+", " "))


def term_counts(
    rows: DataFrame, term: str, record: str, weight: str, same: list[str], salts: int | None = None
) -> DataFrame:
    """Occurrences, summed weight and number of records of each folded term.

    Rows equal in the term as delivered, the record and all columns of ``same`` count once. Rows are hashed on the
    folded term and one of ``salts`` salts (as many as there are shuffle partitions by default) taken from the record, or
    from the row where the record is null, so a term that holds a third of the table is spread over that many tasks, and
    all rows of one term in one record, and all equal rows, still meet. Within a task rows come ordered by term and record; a
    counter compares each row with the one last seen (the preceding row) and needs no set of records. The salts'
    partial counts are then summed, which is exact because no record is in two salts.

    Null and empty folded terms are left out. A null weight counts as 0, a null record as no record. An empty table
    gives no rows; other columns of the input are ignored, whatever their names.
    """
    raw = [F.col(c).alias(f"_s{i}") for i, c in enumerate(same)]
    base = rows.select(
        fold_term(F.col(term)).alias("term"), F.col(term).alias("_raw"), F.col(record).cast("string").alias("_record"), F.col(weight).cast("long").alias("_weight"), *raw
    ).where(F.col("term") != "")
    row = ["_raw", "_weight", *(f"_s{i}" for i in range(len(same)))]
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark = F.when(F.col("_record").isNull(), F.xxhash64(*row)).otherwise(F.xxhash64("_record"))
    base = base.withColumn("_salt", F.pmod(mark, F.lit(salts)).cast("int"))
    order = Window.partitionBy("term", "_salt").orderBy("_record", *row)
    last = lambda c: F.lag(c).over(order)
    new_record = F.col("_record").isNotNull() & ~F.col("_record").eqNullSafe(last("_record"))
    first = last(F.lit(1)).isNull()
    same_row = F.col("_record").eqNullSafe(last("_record"))
    for c in row:
        same_row = same_row & F.col(c).eqNullSafe(last(c))
    counted = base.select("term", "_salt", "_weight", new_record.alias("_new"), (first | ~same_row).alias("_counts"))
    partial = counted.groupBy("term", "_salt").agg(
        F.count_if("_counts").alias("o"), F.sum(F.when(F.col("_counts"), F.coalesce("_weight", F.lit(0)))).alias("w"), F.count_if("_new").alias("r")
    )
    return partial.groupBy("term").agg(F.sum("o").alias("occurrences"), F.coalesce(F.sum("w"), F.lit(0)).alias("weight"), F.sum("r").alias("records"))


def mark_terms(counts: DataFrame, rows: DataFrame, record: str, rare_below: int = 5, common_share: float = 0.2) -> DataFrame:
    """Add ``marks``: 'rare' if the weight is under ``rare_below``, 'common' if more than ``common_share`` of all records hold the term.

    The number of all distinct records of the table comes from a scalar subquery. Both marks may hold; none gives an
    empty list.
    """
    total = rows.agg(F.count_distinct(record)).scalar()
    rare = F.when(F.col("weight") < rare_below, F.lit("rare"))
    common = F.when(F.col("records") > F.lit(common_share) * total, F.lit("common"))
    return counts.withColumn("marks", F.array_compact(F.array(rare, common)))
