"""Cutting documents into chunks: fixed windows, or windows within the sections that headings open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.text import bind, citation_label, paragraphs, strip

#: The phrases that open a section, in the order in which groups are tried; ``.?`` allows any apostrophe.
HEADINGS = {
    "responsibilities": [
        "what you.?ll (?:do|be doing)", "responsibilities", "the role", "about the role", "your (?:role|impact|mission)", "in this role", "day to day", "what the job involves",
    ],
    "requirements": [
        "requirements", "qualifications", "what (?:we.?re looking for|you.?ll (?:need|bring))", "about you", "who you are", "minimum qualifications", "basic qualifications",
        "skills(?: and experience)?", "experience required", "you (?:have|should have)",
    ],
    "nice_to_have": ["nice to have", "bonus", "preferred qualifications", "preferred", "even better", "plus(?:es)?", "desirable", "it.?s a plus"],
    "compensation": ["compensation", "salary", "pay(?: range| transparency)?", "what we offer", "benefits", "perks", "total rewards"],
    "about_company": ["about (?:us|the company|the team)", "who we are", "our (?:mission|story|team)", "company overview"],
}
#: A whole line that is a heading: an optional bullet before it, an optional colon after it.
HEADING = r"(?i)^\s*(?:[#*\-•]\s*)?(?:" + "|".join(p for group in HEADINGS.values() for p in group) + r")\s*:?\s*$"


def section_of(heading: Column) -> Column:
    """Section of a heading line: the first group with a phrase anywhere in it, else 'other'."""
    out = F.lit("other")
    for name, phrases in reversed(HEADINGS.items()):
        out = F.when(heading.rlike(f"(?i)({'|'.join(phrases)})"), name).otherwise(out)
    return out


def section_array(text: Column) -> Column:
    """Array of (ord, section, body): text before the first heading is 'other'; empty bodies are dropped; no heading, one 'other'.

    Heading lines are found by their index, and each one's body is a slice of the lines, all inside the row.
    """

    def cut(lines: Column) -> Column:
        marks = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(HEADING), i)), lambda i: i.isNotNull())
        return bind(F.concat(F.array(F.lit(-1)), marks), lambda at: made(lines, at))

    def made(lines: Column, at: Column) -> Column:
        stop = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(lines)))
        body = lambda a, b: strip(F.array_join(F.slice(lines, a + 2, F.greatest(b - a - 1, F.lit(0))), "\n"))
        name = lambda a: F.when(a < 0, F.lit("other")).otherwise(section_of(F.get(lines, a)))
        both = F.zip_with(at, stop, lambda a, b: F.struct(name(a).alias("section"), body(a, b).alias("body")))
        return F.filter(F.transform(both, lambda s, i: F.struct(i.alias("ord"), s["section"].alias("section"), s["body"].alias("body"))), lambda s: s["body"] != "")

    return bind(F.split(F.coalesce(text, F.lit("")), "\n"), cut)


def sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, section, body of each section of a text; see ``section_array``."""
    return rows.select(F.col(key).alias("key"), F.inline(section_array(F.col(text))))


def windows(text: Column, size: int = 1600, overlap: int = 200, delimiter: str = "\n\n") -> Column:
    """Pieces of a text, packed from paragraphs; a fold over the paragraph array, so it stays in Catalyst.

    A text within ``size`` is one piece (none if blank). Paragraphs are packed while they fit; on overflow the next piece
    starts with the last ``overlap`` characters of the one before. What is longer than ``size`` by itself is cut hard.
    """
    step, gap = size - overlap, len(delimiter)

    def merge(state: Column, part: Column) -> Column:
        current, out = state["current"], state["out"]
        fits = (current == "") | (F.length(current) + F.length(part) + gap <= size)
        joined = F.when(current == "", part).otherwise(F.concat(current, F.lit(delimiter), part))
        seeded = F.concat(F.substring(current, -overlap, overlap), F.lit(delimiter), part)
        grown, kept = F.when(fits, joined).otherwise(seeded), F.when(fits, out).otherwise(F.concat(out, F.array(current)))
        cuts = F.greatest(F.ceil((F.length(grown) - size) / step).cast("int"), F.lit(0))
        hard = F.when(cuts > 0, F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.substring(grown, 1 + i * step, F.lit(size)))).otherwise(F.array().cast("array<string>"))
        rest = F.substring(grown, 1 + cuts * step, F.length(grown))
        return F.struct(F.concat(kept, hard).alias("out"), rest.alias("current"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("current"))
    folded = F.aggregate(paragraphs(text, delimiter), start, merge, lambda s: F.concat(s["out"], F.array(s["current"])))
    whole = F.array(F.coalesce(text, F.lit("")))
    return F.filter(F.when(F.length(F.coalesce(text, F.lit(""))) <= size, whole).otherwise(folded), lambda p: p.rlike(rf"[^\s\x0B\p{{Z}}]"))


def chunk(
    rows: DataFrame, strategy: str, key: str = "doc_id", text: str = "text", company: str = "source", title: str = "title", location: str | None = None, carry: tuple[str, ...] = (),
    size: int = 1600, overlap: int = 200, least: int = 80, delimiter: str = "\n\n",
) -> DataFrame:
    """id, key, strategy, section, raw, text and the carried columns of each chunk of at least ``least`` characters.

    ``fixed`` cuts the whole text, ``section`` each section; a text without any section piece is cut as a whole, its
    chunks being marked as ``fixed`` ones. A chunk's id numbers it among all pieces of its document; its text is the raw
    piece under a heading of company, title, location (in brackets, where one is given) and section. One narrow pass:
    pieces are made and numbered inside the row. Columns are picked by name, so clashing ones do no harm.
    """
    if strategy not in ("fixed", "section"):
        raise ValueError(f"no such strategy: {strategy}")
    named = lambda section, cut: F.transform(cut, lambda p: F.struct(section.alias("section"), p.alias("raw")))
    whole = named(F.lit("unknown"), windows(F.col("_text"), size, overlap, delimiter))
    base = rows.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(company).alias("_company"), F.col(title).alias("_title"), (F.col(location) if location else F.lit(None)).cast("string").alias("_location"),
        *[F.col(c).alias(f"_c_{c}") for c in carry],
    ).where("_text IS NOT NULL")
    if strategy == "fixed":
        made = base.withColumn("_pieces", whole).withColumn("_strategy", F.lit("fixed"))
    else:
        cut = F.flatten(F.transform(section_array(F.col("_text")), lambda s: named(s["section"], windows(s["body"], size, overlap, delimiter))))
        made = base.withColumn("_cut", cut).withColumn("_strategy", F.when(F.size("_cut") > 0, "section").otherwise("fixed"))
        made = made.withColumn("_pieces", F.when(F.size("_cut") > 0, F.col("_cut")).otherwise(whole))
    told = [F.col(f"_c_{c}") for c in carry]
    each = made.select("_key", "_company", "_title", "_location", "_strategy", *told, F.posexplode("_pieces").alias("_n", "_piece")).where(F.length("_piece.raw") >= least)
    section, raw = F.col("_piece.section"), F.col("_piece.raw")
    place = F.when(F.coalesce("_location", F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" ("), F.col("_location"), F.lit(")")))
    head = F.when(section.isin("other", "unknown"), F.lit("")).otherwise(F.concat(F.lit(" ["), F.replace(section, F.lit("_"), F.lit(" ")), F.lit("]")))
    return each.select(
        F.concat_ws("::", F.col("_key").cast("string"), "_strategy", F.col("_n").cast("string")).alias("id"), F.col("_key").alias(key), F.col("_strategy").alias("strategy"), section.alias("section"), raw.alias("raw"),
        F.concat(citation_label(F.col("_company"), F.col("_title")), place, head, F.lit("\n\n"), raw).alias("text"), *[c.alias(n) for c, n in zip(told, carry)],
    )


def section_stats(chunks: DataFrame) -> DataFrame:
    """By strategy and section: chunks and their share of the strategy's, rounded; the most frequent section first."""
    counted = chunks.groupBy("strategy", "section").agg(F.count(F.lit(1)).alias("chunks"))
    share = F.round(F.col("chunks") / F.sum("chunks").over(Window.partitionBy("strategy")), 4)
    order = Window.partitionBy("strategy").orderBy(F.desc("chunks"), "section")
    return counted.withColumn("share", share).withColumn("ord", F.row_number().over(order))


def stats(chunks: DataFrame) -> DataFrame:
    """By strategy: chunks, mean (rounded down), least and most characters of the raw text."""
    n = F.length("raw")
    return chunks.groupBy("strategy").agg(F.count(F.lit(1)).alias("chunks"), F.floor(F.sum(n) / F.count(F.lit(1))).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


def compare(chunks: DataFrame) -> DataFrame:
    """One row: chunk counts and mean sizes of both strategies and their ratios."""
    one = lambda s: stats(chunks.where(F.col("strategy") == s)).select(F.lit(1).alias("k"), F.col("chunks").alias(f"{s}_chunks"), F.col("mean_chars").alias(f"{s}_mean"))
    both = one("section").join(one("fixed"), "k").drop("k")
    ratio = lambda c: F.round(F.col(f"section_{c}") / F.greatest(F.col(f"fixed_{c}"), F.lit(1)), 4)
    return both.withColumn("count_ratio", ratio("chunks")).withColumn("size_ratio", ratio("mean"))
