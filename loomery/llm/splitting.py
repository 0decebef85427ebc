"""Splitting of oversized texts where their vocabulary turns over."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.arrow import batch_of, map_arrow, words

#: Ends of lines and of sentences (of any script); a piece may start after one.
PAUSE = re.compile(r"\n\s*|(?<=[.!?;:…])[\"')\]]*\s+|(?<=[。！？；])")
SPACE = re.compile(r"\s+")


class _Block:
    """Word counts of some neighbouring sentences, with the dot product against the block across the gap."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self.square = 0

    def add(self, sentence: list[str], other: _Block) -> int:
        gained, counts = 0, self.counts
        for w in sentence:
            n = counts.get(w, 0)
            self.square += 2 * n + 1
            counts[w] = n + 1
            gained += other.counts.get(w, 0)
        return gained

    def remove(self, sentence: list[str], other: _Block) -> int:
        lost, counts = 0, self.counts
        for w in sentence:
            n = counts[w]
            self.square -= 2 * n - 1
            counts[w] = n - 1
            lost += other.counts.get(w, 0)
        return lost


def valley_depths(sentences: list[list[str]], width: int) -> list[float]:
    """Depth of the similarity valley at each gap between sentences.

    At a gap, the cosine of the word counts of up to ``width`` sentences on either side is its cohesion. The depth is
    how far the cohesion rises from there to the nearest peak on the left plus the same on the right.
    """
    left, right = _Block(), _Block()
    n, dot = len(sentences), 0
    for s in sentences[:width]:
        right.add(s, left)
    cohesion = []
    held: deque[int] = deque()
    for gap in range(1, n):
        s = sentences[gap - 1]
        dot -= right.remove(s, left)
        dot += left.add(s, right)
        held.append(gap - 1)
        if len(held) > width:
            dot -= left.remove(sentences[held.popleft()], right)
        if gap - 1 + width < n:
            dot += right.add(sentences[gap - 1 + width], left)
        cohesion.append(dot / (left.square * right.square) ** 0.5 if left.square and right.square else 0.0)
    rise = [0.0] * len(cohesion)
    for order in (range(len(cohesion)), range(len(cohesion) - 1, -1, -1)):
        peak = before = 0.0
        for i in order:
            if before < cohesion[i]:
                peak = cohesion[i]
            rise[i] += peak - cohesion[i]
            before = cohesion[i]
    return rise


def cut_points(text: str, size: int, overlap: int, width: int = 3) -> list[int]:
    """Ends of the pieces of a text; each next piece starts ``overlap`` characters before the last end.

    Within the window that the size allows (from half a piece on), the gap between sentences or lines with the
    deepest valley is taken, the later one on ties; without a gap the last white space; without that the full size.
    """
    if len(text) <= size:
        return [len(text)]
    gaps, sentences, start = [], [], 0
    for found in PAUSE.finditer(text):
        end = found.end()
        if start < end < len(text):
            gaps.append(end)
            sentences.append(words(text[start:end]))
            start = end
    sentences.append(words(text[start:]))
    depth = valley_depths(sentences, width)
    ends, start = [], 0
    while len(text) - start > size:
        low, high = start + max(size // 2, overlap + 1), start + size
        a, b = bisect_left(gaps, low), bisect_right(gaps, high)
        if a < b:
            end = gaps[max(range(a, b), key=lambda i: (depth[i], i))]
        else:
            spaces = [m.end() for m in SPACE.finditer(text, low, high)]
            end = spaces[-1] if spaces else high
        ends.append(end)
        start = end - overlap
    return [*ends, len(text)]


def split_oversized(
    rows: DataFrame, key: str = "hit_id", text: str = "text", section: str = "section", size: int = 1600, overlap: int = 200, width: int = 3
) -> DataFrame:
    """Pieces of every text of more than ``size`` characters: key, section, piece_no (from 0), pieces, start, text.

    Pieces follow each other, none is longer than ``size``, each next one repeats the last ``overlap`` characters of
    the one before, and without these repeats they join to the text as stored. Cuts are chosen by lexical cohesion
    (see ``cut_points``). Null, empty and shorter texts give no rows, blank oversized ones are cut like others; a null
    section stays null; repeated keys give repeated pieces. Narrow: one pass, no shuffle, other columns are not read.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be under half the size")
    kind = rows.schema[key].dataType.simpleString()

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, names, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        at, number, count, starts, pieces = [], [], [], [], []
        for i, t in enumerate(texts):
            ends = cut_points(t, size, overlap, width)
            start = 0
            for n, end in enumerate(ends):
                at.append(i)
                number.append(n)
                count.append(len(ends))
                starts.append(start)
                pieces.append(t[start:end])
                start = end - overlap
        return batch_of(**{
            key: (keys.take(pa.array(at, pa.int64())), None), "section": ([names[i] for i in at], pa.string()), "piece_no": (number, pa.int32()),
            "pieces": (count, pa.int32()), "start": (starts, pa.int64()), "text": (pieces, pa.string()),
        })

    big = rows.select(F.col(key).alias(key), F.col(section).alias("_section"), F.col(text).alias("_text")).where(F.length("_text") > size)
    return map_arrow(big, split, f"`{key}` {kind}, section string, piece_no int, pieces int, start long, text string")
