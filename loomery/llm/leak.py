"""Evaluation texts that stand, wholly or in part, inside corpus documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.arrow import join_hot, lists_of, map_arrow, words
from loomery.session import stash

#: Words of a shingle, and the largest filter of the items' shingles, in bits (32 MB).
SHINGLE, MOST_BITS = 5, 2**28


class Hasher:
    """64-bit hashes of words, each computed once as long as ``most`` distinct ones are not exceeded."""

    def __init__(self, most: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, held: list[str]) -> np.ndarray:
        known = self.known
        out = np.empty(len(held), np.int64)
        for i, w in enumerate(held):
            h = known.get(w)
            if h is None:
                if len(known) >= self.most:
                    known.clear()
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) - 2**63
            out[i] = h
        return out


def shingles_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """int64 hash of each ``width`` neighbouring words."""
    x = hashes.view(np.uint64)
    n = max(len(x) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def item_shingles(items: DataFrame, key: str, texts: tuple[str, ...], run: int, width: int) -> DataFrame:
    """item (a number), id, words and shingles, as hashes, of each item text of at least ``run`` words."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        hasher = Hasher()
        at, held = [], []
        for column in batch.columns[1:]:
            for i, t in enumerate(column.to_pylist()):
                ws = words(t)
                if len(ws) >= run:
                    at.append(i)
                    held.append(hasher(ws))
        ids = batch.column(0).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, lists_of(held, pa.int64()), lists_of([shingles_of(h, width) for h in held], pa.int64())], names=["id", "words", "shingles"])

    read_items = items.select(F.col(key).cast("string").alias("id"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(texts)]).where("id IS NOT NULL")
    return stash(map_arrow(read_items, read, "id string, words array<long>, shingles array<long>").withColumn("item", F.monotonically_increasing_id()))


def shingle_filter(items: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bits, in uint64 words, at which some item's shingle falls; their number is a power of two and bounded.

    The bits are united by the executors; the driver gets at most ``most_bits`` of them, however many items there are. A
    fuller filter only lets more through to the exact join.
    """
    n = items.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    bits = min(most_bits, max(2**16, 1 << int(16 * n).bit_length()))
    at = F.col("h").bitwiseAND(bits - 1)
    united = items.select(F.explode("shingles").alias("h")).select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = united.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def stretches(rows: DataFrame, key: str, text: str, bits: np.ndarray, run: int, width: int) -> DataFrame:
    """row, key, words and shingles of each stretch of a text all of whose shingles pass the filter, if it is long enough
    to hold a run. One narrow pass over the corpus; ``row`` tells repeated keys apart."""
    kind = rows.schema[key].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(bits)
    need = run - width + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = Hasher(), sent.value
        mask = np.int64(len(held) * 64 - 1)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            at, row, found, hashed = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ws = words(t.as_py())
                number += 1
                if len(ws) < run:
                    continue
                hashes = hasher(ws)
                shingles = shingles_of(hashes, width)
                place = shingles & mask
                passed = (held[place >> 6] >> (shingles & 63).view(np.uint64)) & np.uint64(1)
                edge = np.flatnonzero(np.diff(passed.astype(np.int8), prepend=0, append=0))
                for a, b in zip(edge[::2], edge[1::2]):
                    if b - a >= need:
                        at.append(i)
                        row.append(number)
                        found.append(hashes[a : b + width - 1])
                        hashed.append(shingles[a:b])
            if at:
                keys = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), keys, lists_of(found, pa.int64()), lists_of(hashed, pa.int64())], names=["row", key, "words", "shingles"])

    document = rows.select(F.col(key).alias(key), F.col(text).alias("_text")).where(F.length("_text") >= 2 * run - 1)
    return document.mapInArrow(find, f"row long, `{key}` {kind}, words array<long>, shingles array<long>")


def agreeing(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), lambda s, e: F.struct((s["n"] + (s["open"] & e).cast("int")).alias("n"), (s["open"] & e).alias("open")), lambda s: s["n"])


def placed(table: DataFrame, keep: list[str], reach: int, width: int) -> DataFrame:
    """``keep``, at, shingle, and up to ``reach`` words before it (nearest first) and after it, for each shingle of a row."""
    around = F.transform(
        "shingles",
        lambda s, i: F.struct(
            i.alias("at"), s.alias("shingle"), F.reverse(F.slice("words", F.greatest(i - reach + 1, F.lit(1)), F.least(i, F.lit(reach)))).alias("before"), F.slice("words", i + width + 1, F.lit(reach)).alias("after")
        ),
    )
    return table.select(*keep, F.inline(around))


def leaked_items(
    rows: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "id", item_texts: tuple[str, ...] = ("question", "passage"), run: int = 12, most_bits: int = MOST_BITS
) -> DataFrame:
    """``key`` and question_id of each document that holds ``run`` consecutive words of one of an item's texts.

    A document that holds a window of ``run`` words of an item holds all the window's shingles of five words. One pass over
    the corpus keeps the stretches of text whose shingles all pass a filter of the items' shingles. Shingles are ordered by
    how many of these texts hold them; of each window the rarest one is its prefix, and a window with a shingle that no
    text holds is dropped. Prefixes and stretches are joined on the shingle; where they meet the alignment is fixed, the
    lengths on both sides bound the possible run, and the words around are compared one by one (by 64-bit hashes). The
    result is exact. Neither texts nor items are collected; the corpus is read once, however many items there are, and
    only the filter, of at most ``most_bits`` bits, is broadcast. A shingle that many texts hold is split off.

    Null, empty and blank texts and items match nothing, nor does an item text of fewer than ``run`` words or an item
    without id. One row for each row of the corpus and item, also for repeated rows. Empty tables give no rows; other
    columns are not read.
    """
    width = min(SHINGLE, run)
    need, reach = run - width + 1, run - width
    asked = item_shingles(items, item_key, item_texts, run, width)
    held = stash(stretches(rows, key, text, shingle_filter(asked, most_bits), run, width))
    counts = stash(held.select("row", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count_distinct("row").alias("n"), F.count(F.lit(1)).alias("rows")))
    each = asked.select("item", F.posexplode("shingles").alias("at", "shingle")).join(counts.select("shingle", "n"), "shingle", "left")
    window = Window.partitionBy("item").orderBy("at").rowsBetween(0, need - 1)
    rarest = each.select("item", F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).over(window).alias("least"), F.count(F.lit(1)).over(window).alias("of"))
    prefix = rarest.where((F.col("of") == need) & (F.col("least.n") > 0)).select("item", "least.at").distinct()
    theirs = placed(asked, ["item", "id"], reach, width).join(prefix, ["item", "at"]).select("shingle", "id", F.col("before").alias("b"), F.col("after").alias("a"))
    met = join_hot(placed(held, ["row", key], reach, width), stash(theirs), "shingle", counts, "rows")
    possible = F.least(F.size("before"), F.size("b")) + F.least(F.size("after"), F.size("a")) >= reach
    found = met.where(possible).where(agreeing(F.col("before"), F.col("b")) + agreeing(F.col("after"), F.col("a")) >= reach)
    return found.select("row", key, F.col("id").alias("question_id")).distinct().drop("row")
