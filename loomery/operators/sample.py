"""Samples that are fair to small sources, and snapshots compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.text import or_default


def first_of_each(rows: DataFrame, n: int, source: str, order: str) -> DataFrame:
    """The first n rows of each source by ``order``; the limit runs before the shuffle, so a large source costs little."""
    at = Window.partitionBy(or_default(F.col(source), "unknown")).orderBy(order)
    return rows.withColumn("slot", F.row_number().over(at)).where(F.col("slot") <= n)


def round_robin(rows: DataFrame, n: int, source: str, order: str) -> DataFrame:
    """n rows: each source's first, the widest source first, then each one's second, and so on.

    No source can give more than n rows, so only so many of each are kept before ordering.
    """
    name = or_default(F.col(source), "unknown")
    widths = rows.groupBy(name.alias("_name")).agg(F.count(F.lit(1)).alias("_width"), F.min(order).alias("_first"))
    held = first_of_each(rows, n, source, order).withColumn("_name", name).join(widths, "_name")
    return held.orderBy("slot", F.desc("_width"), "_first").limit(n).drop("_name", "_width", "_first")


def snapshot_delta(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and state (new, closed, changed, same): a full outer comparison of fingerprints; whole rows never meet."""
    mark = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    a, b = before.select(F.col(key), mark.alias("a")), after.select(F.col(key), mark.alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "closed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def top_counts(rows: DataFrame, column: str, first: int = 6) -> DataFrame:
    """column, n, ord: the most frequent values, nulls and empty ones as 'unknown', ties by name."""
    counted = rows.groupBy(or_default(F.col(column), "unknown").alias(column)).agg(F.count(F.lit(1)).alias("n"))
    best = counted.orderBy(F.desc("n"), column).limit(first)
    return best.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("n"), column)))  # of ``first`` rows
