"""Incremental ingestion: a stream of postings merged into a snapshot, and windowed counts with late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomery.operators.sample import snapshot_delta


def latest_by_key(stream: DataFrame, key: str, time: str, lateness: str = "7 days") -> DataFrame:
    """First delivery of each key within the watermark; redelivered rows are dropped with bounded state."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", lateness: str = "7 days") -> DataFrame:
    """Rows in each tumbling window and group, final once the watermark has passed."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))


def batch_delta(before: DataFrame, batch: DataFrame, key: str, columns: list[str], time: str | None = None, closed: str | None = None) -> DataFrame:
    """key and state of the keys of one batch alone: closed (a row that says so in the boolean column ``closed``), new,
    changed or same. Keys that are not in the batch have not been heard of, which says nothing about them.

    Of several rows of a key the latest by ``time`` counts (without it the greatest row), ties going to the greatest row.
    """
    mark = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    gone = F.coalesce(F.col(closed), F.lit(False)) if closed else F.lit(False)
    said = batch.select(F.col(key), (F.col(time) if time else F.lit(0)).alias("_time"), mark.alias("b"), gone.alias("gone")).groupBy(key).agg(F.max(F.struct("_time", "gone", "b")).alias("last"))
    last = said.select(key, "last.b", "last.gone")
    held = before.select(F.col(key), mark.alias("a"))
    state = F.when(F.col("gone"), "closed").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return last.join(held, key, "left").select(key, state.alias("state"))


def merge_into(
    stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, columns: list[str], checkpoint: str, time: str | None = None, closed: str | None = None, full: bool = False
) -> StreamingQuery:
    """Compare each micro-batch with the snapshot and hand the states of its keys to ``write``; see ``batch_delta``.

    Only if every batch is a ``full`` snapshot are keys that it lacks closed. ``write`` gets the batch's number and must be
    idempotent in it; with that, each batch counts exactly once.
    """

    def step(batch: DataFrame, number: int) -> None:
        write(snapshot_delta(read(), batch, key, columns) if full else batch_delta(read(), batch, key, columns, time, closed), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
