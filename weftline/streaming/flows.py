"""Streams over events and listings: windows with late data, once-a-day entries, lost jobs and incremental sync."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions.exprs import set_key
from weftline.operators.listings import latest, stored_rows, sync


def counts_by_window(events: DataFrame, at: str = "ts", kind: str = "event_type", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events of each kind and window; a window is final once the watermark has passed it, later rows are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def once_a_day(entries: DataFrame, user: str, items: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """The first entry of each user, day and set of items within the watermark."""
    keyed = entries.withColumns({"day": F.date_format(at, "yyyy-MM-dd"), "set_key": set_key(items)})
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark([user, "day", "set_key"])


def _lost(seconds: int) -> Callable:
    def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "last": [pd.Timestamp(last, unit="us")], "lost": [True]})
            return
        newest = max((int(b["ts"].max().value // 1000) for b in batches), default=0)
        last = max(newest, state.get[0] if state.exists else 0)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [key[0]], "last": [pd.Timestamp(last, unit="us")], "lost": [False]})

    return track


def lost_jobs(beats: DataFrame, seconds: int = 120, late: str = "0 seconds") -> DataFrame:
    """(job, last, lost) from beats (job, ts): a row for each batch of beats, and one when a job falls silent for seconds."""
    return (
        beats.withWatermark("ts", late)
        .groupBy("job")
        .applyInPandasWithState(_lost(seconds), "job string, last timestamp, lost boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def sync_stream(runs: DataFrame, read_snapshot: Callable[[], DataFrame], write_snapshot: Callable[[DataFrame, int], None], complete: bool = False, newest: str | None = None):
    """A writer that folds each micro-batch of listings into the stored snapshot; its caller starts it.

    write_snapshot gets the next snapshot and the batch's number, by which it can tell a batch that comes again. Batches of
    a run that is read page by page aren't complete: they leave no tombstones. Of rows that repeat an id the one with the newest
    time counts, newest being its column; without one, one by a hash of the row.
    """

    def fold(batch: DataFrame, number: int) -> None:
        last = latest(batch, ["external_id"], [F.desc_nulls_last(newest)] if newest else [F.xxhash64(*batch.columns)])
        write_snapshot(stored_rows(sync(read_snapshot(), last, complete)), number)

    return runs.writeStream.foreachBatch(fold)
