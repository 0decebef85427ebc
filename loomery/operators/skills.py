"""Explainable matching of texts by the terms of a taxonomy, and roll-ups over many texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.text import NOT_NAMED, bind
from loomery.session import stash

#: A small default taxonomy; a full one is passed as a parameter of the same shape.
TAXONOMY: dict[str, list[str]] = {
    "Languages": ["python", "java", "scala", "rust", "go", "sql", "kotlin", "swift", "typescript", "bash", "perl", "r", "c++", ".net"],
    "Platforms": ["docker", "kubernetes", "linux", "terraform", "git", "graphql", "react"],
    "Data": ["spark", "kafka", "airflow", "postgres", "redis", "tableau", "excel", "machine learning", "data platform"],
    "Operations": ["procurement", "logistics", "route planning", "capacity planning", "customer support", "vendor management"],
    "Finance": ["tax", "treasury", "payments", "pricing", "insurance"],
}


def normalized(text: Column) -> Column:
    """Lower case, letters, digits and ``+#.`` kept, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"{NOT_NAMED}+", " "))


def terms_in(text: Column, taxonomy: dict[str, list[str]] = TAXONOMY) -> Column:
    """Sorted distinct terms of a text: terms of several words anywhere in it, single words as whole tokens (trailing
    periods dropped), and every run of two to five capitals of the original text. All of it stays in Catalyst."""
    known = sorted({t.lower() for group in taxonomy.values() for t in group})

    def found(plain: Column) -> Column:
        words = F.transform(F.split(plain, " "), lambda w: F.rtrim(w, F.lit(".")))
        single = F.array_intersect(words, F.array(*[F.lit(t) for t in known if " " not in t]))
        return F.array_union(F.filter(F.array(*[F.lit(t) for t in known if " " in t]), lambda t: F.contains(plain, t)), single)

    shouted = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:^|[^A-Za-z0-9_])([A-Z]{2,5})(?![A-Za-z0-9_])"), F.lit(1)), F.lower)
    return F.array_sort(F.array_union(bind(normalized(text), found), shouted))


def emphasis(term: Column, plain: Column) -> Column:
    """How often a term stands in a normalized text, as a substring, at least 1."""
    return F.greatest(F.lit(1), ((F.length(plain) - F.length(F.replace(plain, term, F.lit("")))) / F.length(term)).cast("int"))


def fit(pairs: DataFrame, resume: str = "resume", job: str = "job", gaps: int = 8, taxonomy: dict[str, list[str]] = TAXONOMY) -> DataFrame:
    """``pairs`` with matched, gaps (by weight, then term), fit_percent, core_cut, core_met, core_missing, confidence, n_terms.

    A term's weight is its emphasis in the job. The fit is the matched share of all weight, rounded half to even; core
    terms weigh at least half of the heaviest, never under 2. A job without terms fits 0 with low confidence.
    """
    have = terms_in(F.col(resume), taxonomy)
    weigh = lambda plain: F.transform(terms_in(F.col(job), taxonomy), lambda t: F.struct((-emphasis(t, plain)).alias("w"), t.alias("t")))
    weighed = bind(normalized(F.col(job)), weigh)
    out = pairs.withColumn("_have", have).withColumn("_want", F.array_sort(weighed))
    names = lambda c: F.transform(c, lambda s: s["t"])
    met = F.filter("_want", lambda s: F.array_contains("_have", s["t"]))
    missing = F.filter("_want", lambda s: ~F.array_contains("_have", s["t"]))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a - s["w"])
    out = out.withColumn("_met", met).withColumn("_missing", missing)
    top = F.coalesce(-F.get("_want", F.lit(0))["w"], F.lit(0))
    cut = F.greatest(F.lit(2), F.bround(top * 0.5).cast("int"))
    share = F.when(total("_want") > 0, F.bround(100 * total("_met") / total("_want")).cast("int")).otherwise(0)
    out = out.withColumn("fit_percent", share).withColumn("core_cut", cut)
    core = lambda c: names(F.filter(c, lambda s: -s["w"] >= F.col("core_cut")))
    n = F.size("_want")
    return out.select(
        *pairs.columns, "fit_percent", names("_met").alias("matched"), F.slice(names("_missing"), 1, gaps).alias("gaps"), "core_cut", core("_met").alias("core_met"), core("_missing").alias("core_missing"),
        F.when(n >= 12, "high").when(n >= 6, "medium").otherwise("low").alias("confidence"), n.alias("n_terms"),
    )


def competencies(fitted: DataFrame, key: str, job: str = "job", taxonomy: dict[str, list[str]] = TAXONOMY) -> DataFrame:
    """key, grp, matched, missing (by weight, then term), weight, total, percent (of its terms that are matched), ord: one
    row for each group of the taxonomy that a job mentions, the one it says most about first, ties in the taxonomy's order.

    A job's terms are grouped inside its row, so nothing is shuffled.
    """
    last = {t.lower(): g for g, ts in taxonomy.items() for t in ts}
    group_of = F.create_map(*[F.lit(x) for item in last.items() for x in item])
    weigh = lambda plain: F.transform(terms_in(F.col(job), taxonomy), lambda t: F.struct((-emphasis(t, plain)).alias("w"), t.alias("t")))
    names = lambda c: F.transform(c, lambda x: x["t"])
    row = fitted.select(F.col(key), F.col("matched").alias("_met"), F.array_sort(bind(normalized(F.col(job)), weigh)).alias("_all"))

    def made(group: str, number: int) -> Column:
        held = F.filter("_all", lambda x: F.try_element_at(group_of, x["t"]) == group)
        split = lambda held: F.struct(
            (F.aggregate(held, F.lit(0), lambda a, x: a + x["w"])).alias("w"), F.lit(number).alias("o"), F.lit(group).alias("grp"),
            names(F.filter(held, lambda x: F.array_contains("_met", x["t"]))).alias("matched"), names(F.filter(held, lambda x: ~F.array_contains("_met", x["t"]))).alias("missing"),
        )
        return bind(held, split)

    groups = F.array_sort(F.filter(F.array(*[made(g, i) for i, g in enumerate(taxonomy)]), lambda g: g["w"] < 0))
    each = row.select(key, F.posexplode(groups).alias("ord", "g")).select(key, "g.grp", "g.matched", "g.missing", (-F.col("g.w")).alias("weight"), (F.size("g.matched") + F.size("g.missing")).alias("total"), (F.col("ord") + 1).alias("ord"))
    return each.withColumn("percent", F.bround(100 * F.size("matched") / F.col("total")).cast("int"))


def market(fitted: DataFrame, least_share: float = 0.15, first: int = 8) -> DataFrame:
    """kind (gap or strength), ord, term, postings, core_in, total, share, low: what many fitted jobs ask for and lack.

    Of all fits with any term (``total``), ``postings`` have the term among their gaps, or matched terms, and ``core_in``
    of these among their core terms; ``low`` fits had little to go by. Shares under ``least_share`` are left out, the
    ``first`` of each kind are kept by postings, then core, then term. Gaps are those that the fits list, at most as many
    as ``fit`` was asked for. Terms are counted in their task before they are shuffled.
    """
    told = lambda kind, terms, core: F.transform(F.array_distinct(terms), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"), F.array_contains(core, t).alias("core")))
    held = lambda kind, terms, core: bind(core, lambda c: told(kind, terms, c))
    one = F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("term"), (F.col("confidence") == "low").alias("core")))  # counts the fits themselves
    each = fitted.where("n_terms > 0").select(F.inline(F.concat(one, held("gap", F.col("gaps"), F.col("core_missing")), held("strength", F.col("matched"), F.col("core_met")))))
    counts = stash(each.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("postings"), F.count_if("core").alias("core_in")))
    totals = counts.where("kind = ''").select(F.col("postings").alias("total"), F.col("core_in").alias("low"))
    counted = counts.where("kind <> ''").crossJoin(F.broadcast(totals))  # one row
    share = F.col("postings") / F.col("total")
    order = Window.partitionBy("kind").orderBy(F.desc("postings"), F.desc("core_in"), "term")
    ranked = counted.where(share >= least_share).withColumn("share", F.round(share, 6)).withColumn("ord", F.row_number().over(order))
    return ranked.where(F.col("ord") <= first).select("kind", "ord", "term", "postings", "core_in", "total", "share", "low")


def signals(reports: DataFrame, least_share: float = 0.15) -> DataFrame:
    """The rows of ready-made reports whose share of postings is not weak, with that share."""
    share = F.round(F.col("postings") / F.col("total"), 6)
    return reports.where((F.col("total") > 0) & (F.col("postings") / F.col("total") >= least_share)).withColumn("share", share)


def opener(matched: Column) -> Column:
    """A sentence from up to four matched terms; empty without any."""
    four = F.slice(matched, 1, 4)
    n = F.size(four)
    listed = F.concat(F.array_join(F.slice(four, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(four, -1))
    said = F.when(n == 1, F.get(four, F.lit(0))).otherwise(listed)
    return F.when(n < 1, F.lit("")).otherwise(F.concat(F.lit("My experience covers "), said, F.lit(".")))
