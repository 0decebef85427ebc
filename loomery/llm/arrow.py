"""Helpers for operators that run over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a longest run of letters and digits of any script.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased words of a text, in order; none for null."""
    return WORD.findall(text.lower()) if text else []


def filled(column: Column) -> Column:
    """True where a string is neither null nor made of white space alone."""
    return column.isNotNull() & column.rlike(r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]")


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch; empty results are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def batch_of(**columns: tuple[object, pa.DataType]) -> pa.RecordBatch:
    """A batch of named (values, type) pairs."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in columns.values()], names=list(columns))


def lists_of(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list for each NumPy array, without Python objects for the elements."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def small_enough(df: DataFrame, most: int) -> bool:
    """True if a table that is already materialised has at most ``most`` rows."""
    return df.limit(most + 1).count() <= most


def join_hot(big: DataFrame, small: DataFrame, key: str, counts: DataFrame, count: str, most: int = 2000) -> DataFrame:
    """Inner join of ``big`` and ``small`` on ``key`` with no task for a hot key.

    ``counts`` holds how many rows of ``big`` each key has. Keys with at least 1 / ``most`` of all rows (so at most ``most``
    keys) are joined with a broadcast of their rows of ``small``, the others by whatever join their sizes suggest.
    """
    total = counts.agg(F.coalesce(F.sum(count), F.lit(0))).scalar()
    hot = counts.where(F.col(count) * most >= total).select(key)
    often = small.join(F.broadcast(hot), key, "left_semi")
    rest = big.join(F.broadcast(hot), key, "left_anti").join(small, key)
    return big.join(F.broadcast(often), key).unionByName(rest)
