"""Paragraphs that an employer, or many employers, repeat across documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import bind, fingerprint, or_default, paragraphs
from loomery.session import small_enough, spread, stash


@dataclass(frozen=True)
class Boilerplate:
    """Columns of the input and cut-offs. ``share`` is rounded half to even, as the cut-offs are counts."""

    key: str = "hit_id"
    text: str = "text"
    company: str = "company"
    delimiter: str = "\n"
    min_chars: int = 40
    share: float = 0.15
    least_docs: int = 3
    most_broadcast: int = 300_000

    def documents(self, rows: DataFrame) -> DataFrame:
        """key, company (null and empty together as 'unknown'), chars and paragraphs; other columns are not read."""
        read = spread(rows.select(F.col(self.key).alias("key"), or_default(F.col(self.company), "unknown").alias("company"), F.col(self.text).alias("text")))
        return read.select("key", "company", F.length(F.coalesce("text", F.lit(""))).alias("chars"), paragraphs(F.col("text"), self.delimiter).alias("paragraphs"))

    def print_of(self, paragraph: Column) -> Column:
        """A paragraph's fingerprint; null if it is too short to count."""
        return F.when(F.length(paragraph) >= self.min_chars, fingerprint(paragraph))

    def placed(self, rows: DataFrame) -> DataFrame:
        """One row a paragraph of each document: key, company, pos, paragraph, fp (null if too short to count)."""
        out = self.documents(rows).select("key", "company", F.posexplode("paragraphs").alias("pos", "paragraph"))
        return out.withColumn("fp", self.print_of(F.col("paragraph")))

    def counted(self, rows: DataFrame) -> DataFrame:
        """company, fp, n: in how many of the company's documents the paragraph stands.

        A document's repeats are dropped inside its row, so the count needs one shuffle, combined on the map side.
        """
        prints = F.array_distinct(F.transform(F.filter("paragraphs", lambda p: F.length(p) >= self.min_chars), fingerprint))
        return self.documents(rows).select("company", F.explode(prints).alias("fp")).groupBy("company", "fp").agg(F.count(F.lit(1)).alias("n"))

    def sizes(self, rows: DataFrame) -> DataFrame:
        """company, n_docs over all its documents."""
        return rows.select(or_default(F.col(self.company), "unknown").alias("company")).groupBy("company").agg(F.count(F.lit(1)).alias("n_docs"))

    def of_company(self, rows: DataFrame, counted: DataFrame | None = None) -> DataFrame:
        """company, fp, n, n_docs of what a company repeats; companies with few documents are left alone. ``counted`` may
        hold the counts already."""
        cut = F.greatest(F.lit(2), F.bround(F.col("n_docs") * self.share).cast("int"))
        return (counted or self.counted(rows)).join(self.sizes(rows), "company").where((F.col("n_docs") >= self.least_docs) & (F.col("n") >= cut))

    def of_all(self, rows: DataFrame, counted: DataFrame | None = None) -> DataFrame:
        """fp, companies of what many companies share, counted in companies."""
        counted = counted or self.counted(rows)
        total = self.sizes(rows).agg(F.count(F.lit(1))).scalar()
        shared = counted.groupBy("fp").agg(F.count(F.lit(1)).alias("companies"))
        return shared.where(F.col("companies") >= F.greatest(F.lit(3), F.bround(total * self.share).cast("int")))

    def stripped(self, rows: DataFrame) -> DataFrame:
        """key, company, text without repeated paragraphs, dropped (their number), chars_before, chars_after.

        A company's drop list is short (its paragraphs a text, divided by the share), so the lists are grouped by company
        and travel to the documents, whose paragraphs are filtered inside their row; texts are not shuffled. Lists of more
        than ``most_broadcast`` fingerprints in all are joined with fingerprints and their places instead. Null texts give
        empty ones.
        """
        counted = stash(self.counted(rows))
        own = stash(self.of_company(rows, counted).select("company", "fp"))
        shared = stash(self.of_all(rows, counted).select("fp"))
        documents = self.documents(rows)
        if small_enough(own, self.most_broadcast) and small_enough(shared, self.most_broadcast):
            lists = own.groupBy("company").agg(F.collect_set("fp").alias("own"))
            every = shared.agg(F.collect_set("fp").alias("shared"))
            held = documents.join(F.broadcast(lists), "company", "left").crossJoin(F.broadcast(every))
            drop = F.concat(F.coalesce("own", F.array().cast("array<string>")), "shared")
            flag = lambda prints: bind(F.array_intersect(prints, drop), lambda gone: F.transform(prints, lambda p: F.coalesce(F.array_contains(gone, p), F.lit(False))))
            flags = bind(F.transform("paragraphs", self.print_of), flag)
        else:
            numbered = stash(documents.withColumn("row", F.monotonically_increasing_id()))
            placed = numbered.select("row", "company", F.posexplode(F.transform("paragraphs", self.print_of)).alias("pos", "fp")).where("fp IS NOT NULL")
            dropped = placed.join(own, ["company", "fp"], "left_semi").unionByName(placed.join(shared, "fp", "left_semi"))
            held = numbered.join(dropped.groupBy("row").agg(F.collect_set("pos").alias("gone")), "row", "left")
            flags = F.transform("paragraphs", lambda _, i: F.coalesce(F.array_contains("gone", i), F.lit(False)))
        held = held.withColumn("flags", flags)
        kept = F.array_join(F.filter("paragraphs", lambda _, i: ~F.get("flags", i)), self.delimiter)
        out = held.select("key", "company", kept.alias("text"), F.size(F.filter("flags", lambda f: f)).cast("long").alias("dropped"), F.col("chars").alias("chars_before"))
        return out.withColumn("chars_after", F.length("text")).withColumnRenamed("key", self.key)

    def summary(self, rows: DataFrame) -> DataFrame:
        """One row: docs, companies, dropped paragraphs, characters before and after, share removed, mean characters."""
        before, after = F.sum("chars_before"), F.sum("chars_after")
        return self.stripped(rows).agg(
            F.count(F.lit(1)).alias("docs"), F.count_distinct("company").alias("companies"), F.sum("dropped").alias("dropped"), before.alias("chars_before"), after.alias("chars_after"),
            F.round(100 * (before - after) / F.greatest(before, F.lit(1)), 4).alias("pct_removed"), F.floor(after / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_chars"),
        )

    def most_shared(self, rows: DataFrame, first: int = 3) -> DataFrame:
        """The paragraphs that most companies share, with the first text seen."""
        top = self.of_all(rows).orderBy(F.desc("companies"), "fp").limit(first)
        return top.join(self.samples(rows, top, ["fp"]), "fp")

    def most_repeated(self, rows: DataFrame, first: int = 5) -> DataFrame:
        """The paragraphs that stand in most documents of any one company, with the first text seen."""
        top = self.of_company(rows).orderBy(F.desc("n"), "company", "fp").limit(first)
        return top.join(self.samples(rows, top, ["company", "fp"]), ["company", "fp"])

    def samples(self, rows: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
        """keys and sample: the first text, by key and place, of each of a few paragraphs."""
        return self.placed(rows).join(F.broadcast(top.select(*keys)), keys).groupBy(*keys).agg(F.min_by("paragraph", F.struct("key", "pos")).alias("sample"))

    def offenders(self, rows: DataFrame, first: int = 6) -> DataFrame:
        """The paragraphs repeated in the largest share of a company's documents, with the first text seen."""
        drop = self.of_company(rows).withColumn("share", F.round(F.col("n") / F.col("n_docs"), 6))
        top = drop.orderBy(F.desc("share"), F.desc("n"), "company", "fp").limit(first)
        return top.join(self.samples(rows, top, ["company", "fp"]), ["company", "fp"])
