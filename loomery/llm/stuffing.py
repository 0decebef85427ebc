"""Pages of repeated keywords, tags, menus or links, told from prose by their word distributions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.arrow import batch_of, filled
from loomery.session import stash

#: Words, with each kana or Han character on its own, since those scripts write no blanks.
TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
#: A language profile holds this many of the words that most documents of the language hold.
PROFILE = 80
#: Labels that stand for an unknown or mixed language.
UNKNOWN = ("xx", "un", "zx", "mu")
#: Sentences seldom hold more words than this in a row without a word of a profile.
APART = 8


def language_of(label: Column) -> Column:
    """The first two letters of a language label, lower-cased; null if there are not two."""
    two = F.regexp_extract(F.lower(label), r"^\s*([a-z]{2})", 1)
    return F.when(two.isin("", *UNKNOWN), None).otherwise(two)


def word_profiles(rows: DataFrame, text: str = "text", label: str = "lang", least_documents: int = 5, most_held: int = 300_000) -> DataFrame:
    """language, word, share: of each language the words that most of its documents hold, with their share of its tokens.

    All documents with a label are counted, on the map side first (a task passes its counts on when it holds
    ``most_held`` words). Labels with fewer than ``least_documents`` documents have no profile.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents: Counter[tuple[str, str]] = Counter()
        tokens: Counter[tuple[str, str]] = Counter()

        def out() -> pa.RecordBatch:
            keys = list(tokens)
            batch = batch_of(language=([k[0] for k in keys], pa.string()), word=([k[1] for k in keys], pa.string()), documents=([documents[k] for k in keys], pa.int64()), tokens=([tokens[k] for k in keys], pa.int64()))
            documents.clear()
            tokens.clear()
            return batch

        for batch in batches:
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = Counter(TOKEN.findall(t.lower()))
                for w, n in held.items():
                    tokens[language, w] += n
                    documents[language, w] += 1
                tokens[language, ""] += held.total()
                documents[language, ""] += 1
            if len(tokens) > most_held:
                yield out()
        if tokens:
            yield out()

    labelled = rows.select(language_of(F.col(label)).alias("language"), F.col(text).alias("_text")).where(F.col("language").isNotNull() & filled(F.col("_text")))
    counts = labelled.mapInArrow(count, "language string, word string, documents long, tokens long").groupBy("language", "word").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    top = counts.withColumn("n", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("documents"), "word"))).where(F.col("n") <= PROFILE + 1)
    whole = F.max(F.when(F.col("word") == "", F.col("tokens"))).over(Window.partitionBy("language"))
    size = F.max(F.when(F.col("word") == "", F.col("documents"))).over(Window.partitionBy("language"))
    shares = top.withColumn("whole", whole).withColumn("size", size).where((F.col("size") >= least_documents) & (F.col("word") != ""))
    return shares.select("language", "word", (F.col("tokens") / F.col("whole")).alias("share"))


def loose_share(held: Counter[str], page: list[str], shares: dict[str, float]) -> float:
    """Share of a page's letters in runs of more than ``APART`` words without any word of ``shares``.

    Tags, lists and links leave such runs wherever they stand, also between sentences of one line. A word that is used
    over four times as much as in prose, as by repeated phrases, does not end a run.
    """
    n = len(page)
    ends = {w for w in held.keys() & shares.keys() if held[w] <= 4 * shares[w] * n + 4}
    at = [-1, *[i for i, w in enumerate(page) if w in ends], n]
    return sum(sum(map(len, page[i + 1 : j])) for i, j in zip(at, at[1:]) if j - i > APART) / max(1, sum(map(len, page)))


def page_curves(rows: DataFrame, profiles: dict[str, dict[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each filled page: key, row, language (the nearest profile), tokens, types, likeness to the language's prose, loose
    (the share of its letters far from any word of a profile of any language, so that two languages do no harm) and steps of its rank-frequency curve as (frequency, words of that frequency).

    Likeness is the overlap of the page's distribution with twice the profile's over the profile's words, as a share of
    the profile's mass: about 1 or more for prose; a word that is repeated beyond its use in prose adds nothing. A page
    without words, or without any profile to compare with, counts as like.
    """
    kind = rows.schema[key].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(profiles)
    step = pa.struct([("f", pa.int32()), ("c", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(name, sum(p.values()), {w: 2 * s for w, s in p.items()}) for name, p in sorted(sent.value.items())]
        shares: dict[str, float] = {}
        for p in sent.value.values():
            shares.update({w: s for w, s in p.items() if s > shares.get(w, 0.0)})
        for batch in batches:
            language, tokens, types, likeness, loose, steps = [], [], [], [], [], []
            for t in batch.column(1).to_pylist():
                page = TOKEN.findall(t.lower())
                held = Counter(page)
                n = len(page)
                best, like = None, 0.0 if n else 1.0
                for name, mass, double in known:
                    met = held.keys() & double.keys()
                    value = sum(min(held[w] / n, double[w]) for w in met) / mass if n else 1.0
                    if best is None or value > like:
                        best, like = name, value
                if best is None:
                    like = 1.0
                language.append(best)
                tokens.append(n)
                types.append(len(held))
                likeness.append(like)
                loose.append(loose_share(held, page, shares) if shares else 0.0)
                steps.append([{"f": f, "c": c} for f, c in sorted(Counter(held.values()).items(), reverse=True)])
            yield batch_of(**{
                key: (batch.column(0), None), "language": (language, pa.string()), "tokens": (tokens, pa.int32()), "types": (types, pa.int32()),
                "likeness": (likeness, pa.float64()), "loose": (loose, pa.float64()), "steps": (steps, pa.list_(step)),
            })

    ready = rows.select(F.col(key).alias(key), F.col(text).alias("_text")).where(filled(F.col("_text")))
    mapped = ready.mapInArrow(run, f"`{key}` {kind}, language string, tokens int, types int, likeness double, loose double, steps array<struct<f:int,c:int>>")
    return mapped.withColumn("row", F.monotonically_increasing_id())


def fit_curves(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages with slope and residual of the line through their log-log rank-frequency curve.

    A window over a page's steps gives the ranks of each step; sums of the logarithms of its ranks come from the
    integral, so a page costs as many rows as it has distinct frequencies. A page of one word has slope 0.
    """
    steps = pages.select("row", F.explode("steps").alias("s")).select("row", F.col("s.f").alias("f"), F.col("s.c").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("row").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a, b = F.col("before") + 0.5, F.col("before") + F.col("c") + 0.5
    first = lambda x: x * F.log(x) - x
    second = lambda x: x * (F.log(x) * F.log(x) - 2 * F.log(x) + 2)
    y = F.log(F.col("f").cast("double"))
    placed = steps.withColumn("before", before.cast("double")).withColumn("x1", first(b) - first(a)).withColumn("x2", second(b) - second(a))
    sums = placed.groupBy("row").agg(F.sum("c").cast("double").alias("n"), F.sum("x1").alias("x"), F.sum("x2").alias("xx"), F.sum(y * F.col("c")).alias("y"), F.sum(y * y * F.col("c")).alias("yy"), F.sum(y * F.col("x1")).alias("xy"))
    sxx, sxy, syy = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    slope = F.when((F.col("n") > 1) & (sxx > 1e-9), sxy / sxx).otherwise(0.0)
    fitted = sums.select("row", slope.alias("slope"), F.sqrt(F.greatest(syy - slope * sxy, F.lit(0.0)) / F.col("n")).alias("residual"))
    return pages.drop("steps").join(fitted, "row", "left").fillna(0.0, ["slope", "residual"])


def judge(pages: DataFrame, half: float = 0.5, far: float = 3.8, steep: float = 5.0, apart: float = 2.0, unlike: float = 0.85, least_peers: int = 20) -> DataFrame:
    """Pages with stuffed, told from pages of the same language at comparable lengths (tokens within a factor of two).

    Peers are the pages with at least 0.6 of their language's median likeness, since among long pages the stuffed ones
    may be the majority. Median and spread (from the quartiles) of likeness, loose, slope and residual come from the peers of
    the page's language and length; of its language, then of all, where there are fewer than ``least_peers``. A page is
    stuffed if its likeness is under ``half`` of its peers' median and ``far`` spreads below it (never under the spread that
    sampling alone gives to so few words); or if more than ``half`` of what is not loose in its peers is loose in it, ``apart``
    spreads above them, whatever its sentences score; or if its curve is ``steep`` spreads steeper, or fits its line
    ``steep`` spreads worse, and its likeness is under ``unlike`` of the median.
    """
    sized = pages.withColumn("length", F.floor(F.log2(F.greatest("tokens", F.lit(1)))).cast("int"))
    quartiles = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(c)
    levels = sized.withColumn("language", F.coalesce("language", F.lit("")))
    usual = stash(levels.groupBy("language").agg(F.percentile_approx("likeness", 0.5, 1000).alias("usual")))
    prose = levels.join(F.broadcast(usual), "language").where(F.col("likeness") >= 0.6 * F.col("usual"))
    measures = ("likeness", "loose", "slope", "residual")
    peers = prose.rollup("language", "length").agg(F.count(F.lit(1)).alias("n"), *[quartiles(c) for c in measures], F.grouping_id().alias("level"))
    peers = stash(peers.select("language", "length", "n", "level", *[F.col(c)[1].alias(f"{c}_mid") for c in measures], *[((F.col(c)[2] - F.col(c)[0]) / 1.349).alias(f"{c}_sd") for c in measures]))
    out = levels
    columns = [f"{c}_{k}" for c in measures for k in ("mid", "sd")]
    for level, keys in ((0, ["language", "length"]), (1, ["language"])):
        at = peers.where((F.col("level") == level) & (F.col("n") >= least_peers)).select(*keys, *[F.col(c).alias(f"{c}{level}") for c in columns])
        out = out.join(F.broadcast(at), keys, "left")  # at most the two-letter languages times the powers of two
    out = out.join(F.broadcast(peers.where("level = 3").select(F.lit(True).alias("_all"), *[F.col(c).alias(f"{c}3") for c in columns])), F.lit(True) == F.col("_all"), "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"{c}0", f"{c}1", f"{c}3"))
    chance = F.sqrt(1.5 / F.greatest("tokens", F.lit(1)))
    unlikely = (F.col("likeness_mid") - F.col("likeness")) / F.greatest("likeness_sd", chance)
    diverges = (F.col("likeness") < half * F.col("likeness_mid")) & (unlikely > far)
    more = F.col("loose") - F.col("loose_mid")
    scattered = (more > half * (1 - F.col("loose_mid"))) & (more > apart * F.greatest("loose_sd", F.sqrt(0.5 / F.greatest("tokens", F.lit(1)))))
    steeper = (F.col("slope_mid") - F.col("slope")) / F.greatest("slope_sd", F.lit(0.07)) > steep
    rougher = (F.col("residual") - F.col("residual_mid")) / F.greatest("residual_sd", F.lit(0.04)) > steep
    stuffed = diverges | scattered | ((steeper | rougher) & (F.col("likeness") < unlike * F.col("likeness_mid")))
    return out.select(*pages.columns, stuffed.alias("stuffed"))


def stuffed_pages(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Each filled page with language, tokens, types, likeness, loose, slope, residual and stuffed.

    Null, empty and blank texts are left out; texts without words are never stuffed. Labels only serve to learn the
    languages' profiles: a page is compared with the language it is nearest to, so null and wrong labels do no harm.
    Repeated rows are judged alike. An empty table gives no rows; other columns are not read. What reaches the driver are
    the profiles: at most 80 words for each two-letter label.
    """
    profiles: dict[str, dict[str, float]] = {}
    for r in word_profiles(rows, text, label).collect():
        profiles.setdefault(r.language, {})[r.word] = r.share
    curves = stash(page_curves(rows, profiles, key, text))
    return judge(stash(fit_curves(curves, key))).drop("row")
