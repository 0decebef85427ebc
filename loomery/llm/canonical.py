"""Mapping of freely typed places to a canonical list: token repair by edit distance, then soft TF-IDF over entries."""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.arrow import WORD, batch_of, filled, join_hot, lists_of, map_arrow, small_enough
from loomery.operators.place import AMBIGUOUS, COUNTRY_NAMES, STATES
from loomery.session import stash

#: Most rows of an index of the reference list that is broadcast; a larger one is joined by shuffle, with the same rows.
MOST_BROADCAST = 300_000
#: A word of at least 4 letters that so many names hold may be abbreviated, to at most 4 letters, at this similarity.
COMMON, SHORT, ABBREVIATED = 3, 4, 0.9

_DOTTED = re.compile(r"\b([^\W\d_])\.\s?([^\W\d_])\.?(?![^\W_])")
_PIECE = re.compile(r"[^\w\s]+|_+")


def fold(text: str) -> str:
    """Lower case without accents; letters that do not decompose are spelled out."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return plain.replace("ß", "ss").replace("ł", "l").replace("ø", "o").replace("đ", "d").replace("æ", "ae")


def region_names(countries: dict[str, list[str]] = COUNTRY_NAMES, states: dict[str, str] = STATES) -> dict[tuple[str, ...], str]:
    """Names of regions, as words, with their codes: ``us-xx`` for states, the country's code for countries."""
    named = {name: code for code, names in countries.items() for name in names} | {name: f"us-{code}" for code, name in states.items()}
    return {tuple(WORD.findall(fold(name))): code for name, code in named.items()}


_NAMES = region_names()
_CODES = {code: f"us-{code}" for code in STATES}


def parse_value(value: str, names: dict[tuple[str, ...], str] = _NAMES, most_run: int = 3) -> tuple[list[tuple[str, int]], list[str]]:
    """Tokens of a typed value, each with the number of words in it, and the regions it names.

    Tokens are its words without numbers, and runs of up to ``most_run`` neighbouring words joined (a blank may be lost or
    added by mistake). Regions are state codes as ``us-xx`` and country codes: by name anywhere, by a code of two letters
    that is also a word or a country only at an edge of a piece between punctuation marks, or before "or", numbers aside
    ("in" between words names no region).
    """
    text = _DOTTED.sub(r"\1\2", fold(value))
    pieces = [[w for w in WORD.findall(p) if not w.isdigit()] for p in _PIECE.split(text)]
    words = [w for p in pieces for w in p]
    edges = [w for p in pieces if p for w in (p[0], p[-1], *(a for a, b in zip(p, p[1:]) if b == "or"))]
    codes = {w for w in edges if len(w) == 2} | {w for w in words if w in STATES and w not in AMBIGUOUS}
    regions = {c for w in codes for c in (_CODES.get(w, w), w)}
    for i in range(len(words)):
        for n in range(1, 5):
            code = names.get(tuple(words[i : i + n]))
            if code:
                regions.add(code)
    tokens = [("".join(words[i : i + n]), n) for n in range(1, most_run + 1) for i in range(len(words) - n + 1)]
    return list(dict.fromkeys(tokens)), sorted(regions)


def allowed(length: int) -> int:
    """Edits allowed in a word: none under 6 letters, one under 8, two from there on."""
    return 0 if length < 6 else 1 if length < 8 else 2


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit; ``most`` + 1 if it is higher."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        if min(new) > most:
            return most + 1
        older, old = old, new
    return min(old[-1], most + 1)


def deletion_keys(words: list[str]) -> list[np.ndarray]:
    """Hashes of each word with up to ``allowed`` letters deleted, itself included.

    Two words within the edits allowed to the longer one share such a string: each edit, also a swap, is undone by at most
    one deletion on either side. The hashes of all shortened forms come from those of prefixes and of inner stretches.
    """
    base = 0x9E3779B97F4A7C15
    keys: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        if not n:
            continue
        letters = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(at), n)
        power = np.array([pow(base, k, 2**64) for k in range(n + 1)], np.uint64)
        prefix = np.zeros((n + 1, len(at)), np.uint64)
        for k in range(n):
            prefix[k + 1] = prefix[k] * power[1] + letters[:, k]
        stretch = lambda a, b: prefix[b] - prefix[a] * power[b - a]  # noqa: B023, E731
        forms = []
        for gone in (g for d in range(allowed(n) + 1) for g in combinations(range(n), d)):
            value, start = np.zeros(len(at), np.uint64), 0
            for g in (*gone, n):
                value = value * power[g - start] + stretch(start, g)
                start = g + 1
            forms.append(value * np.uint64(0xD1B54A32D192ED03) ^ np.uint64(n - len(gone)))
        made = np.stack(forms, axis=1).view(np.int64)
        for i, row in zip(at, made):
            keys[i] = row
    return keys


def keyed(words: DataFrame) -> DataFrame:
    """word and each of its deletion keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), lists_of(deletion_keys(batch.column(0).to_pylist()), pa.int64())], names=["word", "keys"])

    return map_arrow(words.select("word"), run, "word string, keys array<long>").select("word", F.explode("keys").alias("key"))


class Reference:
    """The canonical list, indexed for repair and ranking. All statistics are of the whole list; nothing is collected.

    names: name, mass (its words' inverse document frequencies summed), parts (its words with their weights) and places
    (id, region, weight of the region). entries: what a value must hold for a name to come into question, its rarest word
    or all its words joined. vocabulary: the words and joined names that tokens are repaired to.
    """

    def __init__(self, places: DataFrame, most_broadcast: int = MOST_BROADCAST) -> None:
        listed = places.select(F.col("place_id").cast("int").alias("place_id"), "city", "aliases", "state_code", "country_code").where("place_id IS NOT NULL")

        def read(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {"place_id": [], "name": [], "region": []}
            for place, main, others, state, country in zip(*[c.to_pylist() for c in batch.columns]):
                for name in dict.fromkeys(" ".join(WORD.findall(fold(n))) for n in [main, *(others or [])] if n):
                    if name:
                        out["place_id"].append(place)
                        out["name"].append(name)
                        out["region"].append(f"us-{fold(state)}" if state else fold(country or ""))
            return batch_of(place_id=(out["place_id"], pa.int32()), name=(out["name"], pa.string()), region=(out["region"], pa.string()))

        rows = stash(map_arrow(listed, read, "place_id int, name string, region string").distinct())
        total = rows.agg(F.count(F.lit(1))).scalar()
        idf = lambda n: F.log(1 + total / n)
        spread = rows.select(F.explode(F.array_distinct(F.split("name", " "))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        spread = stash(spread.select("word", "n", idf(F.col("n")).alias("weight")))
        regions = rows.groupBy("region").agg(F.count_distinct("place_id").alias("n")).select("region", idf(F.col("n")).alias("weight"))
        where = rows.join(regions, "region").groupBy("name").agg(F.array_sort(F.collect_set(F.struct("place_id", "region", "weight"))).alias("places"))
        words = rows.select("name").distinct().select("name", F.posexplode(F.split("name", " ")).alias("at", "word")).join(spread, "word")
        parts = words.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "word", "weight"))).alias("parts"), F.max_by("word", F.struct("weight", "word")).alias("rarest"), F.sum("weight").alias("mass"))
        self.names = stash(parts.join(where, "name"))
        held = self.names.select("name", "mass", "parts", "places", "rarest")
        rarest = held.where(F.size("parts") > 1).select(F.col("rarest").alias("entry"), F.lit(False).alias("whole"), "name", "mass", "parts", "places")
        joined = held.select(F.replace("name", F.lit(" "), F.lit("")).alias("entry"), F.lit(True).alias("whole"), "name", "mass", "parts", "places")
        self.entries = stash(rarest.union(joined))
        every = held.where(F.size("parts") > 1).select(F.explode("parts.word").alias("word")).union(joined.select("entry"))
        self.vocabulary = stash(every.distinct())
        self.keys = stash(keyed(self.vocabulary).distinct())
        common = spread.where((F.col("n") >= COMMON) & (F.length("word") >= 4)).select("word")

        def shorten(batch: pa.RecordBatch) -> pa.RecordBatch:
            short, word = [], []
            for w in batch.column(0).to_pylist():
                forms = {w[0] + "".join(rest) for n in range(SHORT) for rest in combinations(w[1:], n)} - {w}
                short += forms
                word += [w] * len(forms)
            return batch_of(token=(short, pa.string()), entry=(word, pa.string()))

        self.short = stash(map_arrow(common, shorten, "token string, entry string"))
        few = lambda table: F.broadcast(table) if small_enough(table, most_broadcast) else table
        self.sent = {"entries": few(self.entries), "vocabulary": few(self.vocabulary), "keys": few(self.keys), "short": few(self.short)}

    def repaired(self, tokens: DataFrame) -> DataFrame:
        """token, entry, like, spare: the words of the vocabulary that each distinct token may stand for, and how many
        edits are left to lost and added blanks (any number if the letters agree)."""
        known = tokens.join(self.sent["vocabulary"], tokens["token"] == self.vocabulary["word"]).select("token", F.col("token").alias("entry"), F.lit(1.0).alias("like"), F.lit(9).alias("spare"))
        longest = self.vocabulary.agg(F.max(F.length("word"))).scalar()
        open_tokens = tokens.where(F.length("token").between(5, longest + 2)).join(self.sent["vocabulary"], tokens["token"] == self.vocabulary["word"], "left_anti")
        near = keyed(open_tokens.select(F.col("token").alias("word"))).withColumnRenamed("word", "token").join(self.sent["keys"], "key").select("token", F.col("word").alias("entry"))

        def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = (c.to_pylist() for c in batch.columns)
            most = [allowed(max(len(x), len(y))) for x, y in zip(a, b)]
            found = [edits(x, y, m) for x, y, m in zip(a, b, most)]
            keep = [i for i, (e, m) in enumerate(zip(found, most)) if e <= m]
            at = pa.array(keep, pa.int64())
            return batch_of(token=(batch.column(0).take(at), None), entry=(batch.column(1).take(at), None), like=([1 - found[i] / max(len(a[i]), len(b[i])) for i in keep], pa.float64()), spare=([most[i] - found[i] for i in keep], pa.int32()))

        near = map_arrow(near.distinct(), measure, "token string, entry string, like double, spare int")
        short = tokens.join(self.sent["short"], "token").select("token", "entry", F.lit(ABBREVIATED).alias("like"), F.lit(0).alias("spare"))
        return known.union(near).union(short).groupBy("token", "entry").agg(F.max("like").alias("like"), F.max("spare").alias("spare"))


def similarity(near: Column, entry: Column, words: Column) -> Column:
    """The best similarity of a value's token repaired to an entry of so many words; null without one. A blank too many or
    too few is an edit."""
    held = F.filter(near, lambda x: (x["entry"] == entry) & (F.abs(x["words"] - words) <= x["spare"]))
    return F.array_max(F.transform(held, lambda x: x["like"]))


def explained(near: Column, parts: Column) -> Column:
    """Soft TF-IDF of a name in a value: its words' weights times the similarity of the value's token repaired to them, summed; null unless all are met."""
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["weight"] * similarity(near, p["word"], F.lit(1)))


def map_values(values: DataFrame, places: DataFrame, value: str = "value", least_score: float = 0.6, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The canonical entry of each distinct value: value, place_id (0 where none is meant), score, and rows with that value.

    1. Each distinct value is cut into tokens; each distinct token is joined to the vocabulary of the reference list
       (words of names, and whole names) by edit distance: candidates share a string that both become by deleting the
       letters allowed, the distance is then computed. Short tokens may also abbreviate a word that many names hold.
    2. A value meets a name through the name's rarest word or its words joined; the name's score is the soft TF-IDF of its
       corrected words as a share of its own weight (all words must be met), or the similarity of the whole name.
    3. Entries rank by the weight that they explain of the value: score times the name's weight, and the weight of the
       entry's region if the value names it. If the best name belongs to several places, the region must single out one,
       else none is meant.

    Values are null-safe: null and blank values are left out. An empty list maps everything to 0. Ties go to the lowest
    place_id. All weights are of the whole list, and nothing of it is collected: indexes of at most ``most_broadcast``
    rows are broadcast, larger ones shuffled, with equal results. Tokens and entries that many values hold are split off
    and broadcast, so no task holds all values of one.
    """
    spark = values.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work each: keep all cores busy
    reference = Reference(places, most_broadcast)
    asked = stash(values.select(F.col(value).alias("value")).where(filled(F.col("value"))).groupBy("value").agg(F.count(F.lit(1)).alias("rows")))

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        parsed = [parse_value(v) for v in batch.column(0).to_pylist()]
        return batch_of(value=(batch.column(0), None), tokens=([[{"token": t, "words": n} for t, n in p[0]] for p in parsed], pa.list_(pa.struct([("token", pa.string()), ("words", pa.int32())]))), regions=([p[1] for p in parsed], pa.list_(pa.string())))

    parsed = stash(map_arrow(asked.select("value").repartition(tasks), parse, "value string, tokens array<struct<token:string,words:int>>, regions array<string>"))
    typed = parsed.select("value", F.inline("tokens"))
    tokens = stash(typed.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    repaired = stash(reference.repaired(tokens.select("token").repartition(tasks)))
    met = join_hot(typed, repaired, "token", tokens, "n")
    near = stash(met.groupBy("value").agg(F.collect_set(F.struct("entry", "like", "spare", "words")).alias("near")).join(parsed.select("value", "regions"), "value"))
    each = near.select("value", "regions", "near", F.explode(F.array_distinct("near.entry")).alias("entry"))
    if small_enough(reference.entries, most_broadcast):
        candidates = each.join(reference.sent["entries"], "entry")
    else:
        candidates = join_hot(each, reference.entries, "entry", each.groupBy("entry").agg(F.count(F.lit(1)).alias("n")), "n")
    whole = similarity(F.col("near"), F.col("entry"), F.size("parts"))
    score = F.when(F.col("whole"), whole).otherwise(explained(F.col("near"), F.col("parts")) / F.col("mass"))
    agreeing = F.filter("places", lambda p: F.array_contains("regions", p["region"]))
    scored = candidates.withColumn("score", score).where(F.col("score") >= least_score).withColumn("agreeing", agreeing)
    ids = lambda c: F.array_distinct(F.transform(c, lambda p: p["place_id"]))
    place = F.when(F.size(ids("places")) == 1, F.get("places", F.lit(0))["place_id"]).when(F.size(ids("agreeing")) == 1, F.get("agreeing", F.lit(0))["place_id"]).otherwise(0)
    rank = F.round(F.col("score") * F.col("mass") + F.coalesce(F.array_max(F.transform("agreeing", lambda p: p["weight"])), F.lit(0.0)), 6)
    told = scored.select("value", place.alias("place_id"), "score", rank.alias("rank"), F.array_min(ids("places")).alias("first"))
    chosen = told.groupBy("value").agg(F.max_by(F.struct("place_id", "score"), F.struct("rank", -F.col("first"), "score")).alias("best"))
    return asked.join(chosen, "value", "left").select("value", F.coalesce("best.place_id", F.lit(0)).cast("int").alias("place_id"), F.coalesce("best.score", F.lit(0.0)).alias("score"), "rows")


def map_rows(rows: DataFrame, places: DataFrame, value: str = "value", label: str = "label", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``rows`` with the place_id of their value. Rows whose value is null, blank or exactly a label are left out.

    Repeated values are mapped once; the mapping is joined back by value. The values that many rows hold, at most 2,000 of
    them, are joined by broadcast and the rest by shuffle, so a value that a third of all rows hold is no task's alone.
    """
    labels = places.select(F.col(label).alias("_label")).where(F.col(label).isNotNull()).distinct()
    open_rows = rows.where(filled(F.col(value))).join(F.broadcast(labels) if small_enough(labels, 100_000) else labels, F.col(value) == F.col("_label"), "left_anti")
    mapped = stash(map_values(open_rows, places, value, most_broadcast=most_broadcast).withColumnRenamed("value", "_value"))
    out = join_hot(open_rows.withColumn("_value", F.col(value)), mapped, "_value", mapped, "rows")
    return out.select(*rows.columns, "place_id")
