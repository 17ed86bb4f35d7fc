"""Streams with state of several kinds per key: value and map states, timers, an outbox.

Spark keeps the states in RocksDB beside the executors and their changes in the query's
checkpoint, so neither a key's history nor its waiting rows are held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessella.config import DEFAULT, PatternConfig, QuarantineConfig
from tessella.scale import small_side
from tessella.streaming.live import NOTICE_ROWS, THRESHOLD_ROWS, next_threshold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Result rows that a task holds at once.
RESULT_ROWS = 10_000


def _use_rocksdb(df: DataFrame) -> None:
    """States of several kinds exist in this provider alone."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Thresholds(StatefulProcessor):
    """Signals wait in a map state until the watermark has passed them; then they are applied
    in the order of time and number, whatever the batch that brought them."""

    def __init__(self, start: int, config: PatternConfig) -> None:
        self.start, self.config = start, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "threshold long, occurrences long, used long, ignored long")
        self.waiting = handle.getMapState("waiting", "ts long, seq long", "action string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            for ts, seq, action in zip(micros.tolist(), part["seq"].tolist(), part["action"].tolist()):
                self.waiting.updateValue((ts, seq), (action,))
                last = ts if last is None else max(last, ts)
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted(tuple(k) for k in self.waiting.keys() if k[0] < passed)  # two numbers per signal
        state = self.total.get() if self.total.exists() else (self.start, 0, 0, 0)
        threshold, occurrences, used, ignored = map(int, state)
        log = []
        for at in due:
            action = self.waiting.getValue(at)[0]
            self.waiting.removeKey(at)
            if action == "seen":
                occurrences += 1
                continue
            used += action == "used"
            ignored += action == "ignored"
            after = next_threshold(threshold, occurrences, used, ignored, action, self.config)
            log.append((key[0], at[1], action, threshold, after))
            threshold = after
            if len(log) == RESULT_ROWS:
                yield _threshold_rows(log)
                log = []
        if due:
            self.total.update((threshold, occurrences, used, ignored))
        yield _threshold_rows(log)

    def close(self) -> None:
        pass


def _threshold_rows(log: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(log, columns=["key", "seq", "action", "before", "after"])


def ordered_thresholds(
    signals: DataFrame, lateness: str = "1 hour", start_threshold: int = 12, config: PatternConfig = DEFAULT.patterns
) -> DataFrame:
    """Threshold log of a stream of ``key, ts, seq, action`` signals in any order.

    A signal takes effect once the watermark (the newest ``ts`` less ``lateness``) has passed
    it; signals that come later than that are dropped, as everywhere behind a watermark.
    """
    _use_rocksdb(signals)
    rows = signals.select("key", F.col("ts").cast("timestamp").alias("ts"), "seq", "action")
    return rows.withWatermark("ts", lateness).groupBy("key").transformWithStateInPandas(
        Thresholds(start_threshold, config), THRESHOLD_ROWS, "Append", "EventTime"
    )


class Quarantine(StatefulProcessor):
    """One value per live row, and a timer for its notice."""

    def __init__(self, wait_ms: int, keep_ms: int | None) -> None:
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "reason string, at_ms long, done boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            out = []
            part = part.sort_values("ts")
            for action, reason, ts in zip(part["action"], part["reason"], part["ts"]):
                held = self.entry.get() if self.entry.exists() else None
                if action == "quarantine" and held is None:
                    now = timerValues.getCurrentProcessingTimeInMs()
                    self.entry.update((reason, now, False))
                    self.handle.registerTimer(now + self.wait_ms)
                elif action == "resolve" and held is not None:
                    self.entry.update((held[0], int(held[1]), True))
                    out.append((key[0], "resolve", reason, ts))
                elif action == "release" and held is not None:
                    self.entry.clear()
                    self.handle.deleteTimer(int(held[1]) + self.wait_ms)
                    out.append((key[0], "release", reason, ts))
            yield _notices(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        out = []
        if held is not None and not held[2]:
            out.append((key[0], "notice", held[0], pd.Timestamp(int(held[1]) + self.wait_ms, unit="ms")))
            self.entry.update((held[0], int(held[1]), True))
        yield _notices(out)

    def close(self) -> None:
        pass


def _notices(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["fragment_id", "event", "reason", "at"]).astype({"at": "datetime64[ns]"})


def timed_quarantine(
    events: DataFrame, config: QuarantineConfig = DEFAULT.quarantine, keep_hours: float | None = None
) -> DataFrame:
    """Quarantine with processing-time timers: ``notice``, ``resolve`` and ``release`` rows.

    Input: ``fragment_id, action, reason, ts``. A row that nobody resolves or releases gives one
    notice ``notify_after_hours`` after it came, even if no other event ever follows. Rows are
    forgotten ``keep_hours`` after their last change, where that is given.
    """
    _use_rocksdb(events)
    keep = None if keep_hours is None else int(keep_hours * 3_600_000)
    return events.select("fragment_id", "action", "reason", "ts").groupBy("fragment_id").transformWithStateInPandas(
        Quarantine(int(config.notify_after_hours * 3_600_000), keep), NOTICE_ROWS, "Append", "ProcessingTime"
    )


def outbox_sink(
    notices: DataFrame, path: str, notify: Callable[[DataFrame], None], checkpoint: str, seconds: float | None = None
) -> StreamingQuery:
    """Write each notice once to the ``outbox`` under ``path`` and hand it to ``notify``.

    A batch's notices are stored before they are handed on, under the number of the batch, so
    a repeated batch writes the same rows. What ``notify`` has taken without an error is listed
    under ``sent``; everything else is handed over again with the next batch.
    """

    def send(batch: DataFrame, epoch: int) -> None:
        kept = batch.where("event = 'notice'").select("fragment_id", "reason", "at")
        kept.write.mode("overwrite").parquet(f"{path}/outbox/epoch={epoch}")
        due = waiting_notices(batch.sparkSession, path)
        if due.isEmpty():
            return
        try:
            notify(due)
        except Exception as error:  # foreign code; its notices stay in the outbox
            print(f"notices of batch {epoch} wait for the next one: {error}")
            return
        due.select("fragment_id", "at").write.mode("overwrite").parquet(f"{path}/sent/epoch={epoch}")

    writer = notices.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds").start() if seconds else writer.start()


def waiting_notices(spark, path: str) -> DataFrame:
    """Stored notices that ``notify`` has not taken yet."""
    rows = spark.read.schema("fragment_id string, reason string, at timestamp").parquet(f"{path}/outbox")
    try:
        sent = spark.read.schema("fragment_id string, at timestamp").parquet(f"{path}/sent")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows.select("fragment_id", "reason", "at")
    return rows.join(small_side(sent.select("fragment_id", "at")), ["fragment_id", "at"], "left_anti").select("fragment_id", "reason", "at")
