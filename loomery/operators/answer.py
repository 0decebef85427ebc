"""Context, citations and guards around answers of a pluggable model; the model itself is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import citation_label, or_default

#: The token with which a model refuses, and the share of unsupported claims above which a reply falls.
REFUSAL, UNSUPPORTED = "INSUFFICIENT_CONTEXT", 0.34


def citation_numbers(text: Column) -> Column:
    """All bracketed numbers of a text, in order; grouped forms such as [1, 2] count as none. Null gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d{1,9})\]"), F.lit(1))
    return F.transform(found, lambda n: n.cast("int"))


def citations(text: Column, hits: Column) -> Column:
    """Distinct numbers between 1 and the number of hits, by first appearance."""
    return F.array_distinct(F.filter(citation_numbers(text), lambda n: (n >= 1) & (n <= hits)))


def dangling(text: Column, hits: Column) -> Column:
    """How many citations point at no hit; repeats count."""
    return F.size(F.filter(citation_numbers(text), lambda n: (n < 1) | (n > hits)))


def context(hits: DataFrame, query: str = "qid", rank: str = "rank") -> DataFrame:
    """query and context: the hits in rank order, numbered, each with citation, location and pay, parted by rules."""
    head = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), citation_label(F.col("company"), F.col("title"), F.col("section")))
    place = F.when(F.col("location").isNotNull() & (F.col("location") != ""), F.concat(F.lit(" | "), F.col("location"))).otherwise("")
    pay = F.when(F.col("compensation").isNotNull() & (F.col("compensation") != ""), F.concat(F.lit(" | pay: "), F.col("compensation"))).otherwise("")
    block = F.concat(head, place, pay, F.lit("\n"), or_default(F.col("text"), ""))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b"))))
    return hits.groupBy(query).agg(F.array_join(F.transform(ordered, lambda s: s["b"]), "\n\n---\n\n").alias("context"))


def parse_verdict(reply: Column) -> Column:
    """Struct of total, unsupported, worst, ran: the JSON between the first and the last brace (a judge's
    worst_example counts as worst); ran is false without it."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "total_claims int, unsupported_claims int, worst string, worst_example string")
    ran = parsed["total_claims"].isNotNull() & parsed["unsupported_claims"].isNotNull()
    return F.struct(F.when(ran, parsed["total_claims"]).otherwise(0).alias("total"), F.when(ran, parsed["unsupported_claims"]).otherwise(0).alias("unsupported"), F.when(ran, F.coalesce(parsed["worst"], parsed["worst_example"])).alias("worst"), ran.alias("ran"))


def outcome(top_sim: Column, reply: Column, verdict: Column, least_sim: float = 0.6, most: float = UNSUPPORTED) -> Column:
    """'refused: similarity', 'refused: model', 'refused: claims' or 'answered', in this order of guards.

    A verdict that did not run or saw no claims keeps the answer; the share of unsupported claims must exceed ``most``.
    """
    bad = verdict["ran"] & (verdict["total"] > 0) & (verdict["unsupported"] / verdict["total"] > most)
    return (
        F.when(F.coalesce(top_sim, F.lit(0.0)) < least_sim, "refused: similarity")
        .when(F.contains(F.coalesce(reply, F.lit("")), F.lit(REFUSAL)), "refused: model")
        .when(F.coalesce(bad, F.lit(False)), "refused: claims").otherwise("answered")
    )


def reason(top_sim: Column, reply: Column, verdict: Column, least_sim: float = 0.6, most: float = UNSUPPORTED) -> Column:
    """Why a question is refused, in words; null if it is answered."""
    said = outcome(top_sim, reply, verdict, least_sim, most)
    share = F.concat(verdict["unsupported"].cast("string"), F.lit("/"), verdict["total"].cast("string"))
    return (
        F.when(said == "refused: similarity", F.concat(F.lit("top similarity "), F.round(F.coalesce(top_sim, F.lit(0.0)), 4).cast("string"), F.lit(f" < {least_sim}")))
        .when(said == "refused: model", F.lit("the model found the context insufficient")).when(said == "refused: claims", F.concat(share, F.lit(" claims unsupported")))
    )
