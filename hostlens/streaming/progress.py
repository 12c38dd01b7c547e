"""Download progress: only changes of the whole percent, and the last event of each download."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hostlens.functions.values import clamp, percent

CHANGE = "download_id bigint, seq bigint, done_bytes bigint, total_bytes bigint, pct int, is_final boolean"


def progress_changes(events: DataFrame) -> DataFrame:
    """Batch form: (download_id, seq, done_bytes, total_bytes, pct, shown, is_final).

    An event is kept where its percent differs from the one before; the first is compared with -1, so that a download of
    unknown size has only its final event. The final event repeats the last one of each download. shown: the percent clamped to 0..100.
    """
    order = Window.partitionBy("download_id").orderBy("seq")
    rows = events.select("download_id", "seq", "done_bytes", "total_bytes", percent(F.col("done_bytes"), F.col("total_bytes")).alias("pct"))
    rows = rows.withColumns({"_before": F.lag("pct", 1, -1).over(order), "_last": F.lead("seq").over(order).isNull()})
    kinds = F.array_compact(F.array(F.when(F.col("pct") != F.col("_before"), F.lit(False)), F.when(F.col("_last"), F.lit(True))))
    rows = rows.withColumn("is_final", F.explode(kinds))
    return rows.select("download_id", "seq", "done_bytes", "total_bytes", "pct", clamp(F.col("pct")).alias("shown"), "is_final")


class Changes(StatefulProcessor):
    """The changes of each download in event time, and its final event once nothing has come for `idle_ms`.

    State of a download: the events that the watermark hasn't passed yet, the last one that it has, and one timer: at the first waiting event or, where
    none waits, idle_ms after the last one. A final event clears the state.
    """

    EVENT = "seq bigint, done_bytes bigint, total_bytes bigint, pct int, at_ms bigint"

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.last = handle.getListState("waiting", self.EVENT), handle.getValueState("last", self.EVENT)

    def _wake(self, at_ms: int, now: int) -> None:
        """One timer, the earliest asked for. Those that are due by now are still listed and go by themselves."""
        for other in [t for t in self.handle.listTimers() if t > now]:
            if other <= at_ms:
                return
            self.handle.deleteTimer(other)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is not None and not pd.isna(key[0]):  # rows without a download only move the watermark
            for events in rows:
                events = events[["seq", "done_bytes", "total_bytes", "pct", "at_ms"]]
                self.waiting.appendList([tuple(int(x) for x in r) for r in events.itertuples(index=False, name=None)])
                self._wake(int(events["at_ms"].min()), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        due, later = [e for e in waiting if e[-1] <= now], [e for e in waiting if e[-1] > now]
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for event in due:
            if event[3] != (last[3] if last else -1):
                out.append((*event[:4], False))
            last = event
        if due:
            self.last.update(last)
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if later:
            self._wake(min(e[-1] for e in later), now)
        elif last and last[-1] + self.idle_ms <= now:
            out.append((*last[:4], True))
            self.last.clear()
        elif last:
            self._wake(last[-1] + self.idle_ms, now)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["download_id", "seq", "done_bytes", "total_bytes", "pct", "is_final"])

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, idle: str = "10 minutes", delay: str = "0 seconds") -> DataFrame:
    """Streaming form, with the columns of the batch form: changes once the watermark has passed them, and the final event of a download once
    it has been idle in event time.

    events: download_id, seq, done_bytes, total_bytes and the event time `at`, which must not fall while seq grows. Batches may bring events out of order
    within `delay`. A download that goes on after `idle` counts as a new one. A row of null download_id moves the watermark and no more: a source
    that ends sends one. Needs the RocksDB state store.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = events.withWatermark("at", delay).select("download_id", "seq", "done_bytes", "total_bytes", percent(F.col("done_bytes"), F.col("total_bytes")).alias("pct"), F.unix_millis("at").alias("at_ms"), "at")
    out = rows.groupBy("download_id").transformWithStateInPandas(Changes(idle_ms), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime")
    return out.select("download_id", "seq", "done_bytes", "total_bytes", "pct", clamp(F.col("pct")).alias("shown"), "is_final")
