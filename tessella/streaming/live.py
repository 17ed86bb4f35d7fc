"""Streaming forms of the stateful operators.

State is kept per key by Spark, so executors can be lost at any time; sources,
state and sinks are tied together by the query checkpoint. Every function takes a
streaming DataFrame and returns one, or a started query where a sink is involved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.config import DEFAULT, EngineConfig, PatternConfig, QuarantineConfig
from tessella.operators.gate import admitted, guard, rejections

THRESHOLD_STATE = "threshold long, occurrences long, used long, ignored long"
THRESHOLD_ROWS = "key long, seq long, action string, before long, after long"


def next_threshold(
    threshold: int, occurrences: int, used: int, ignored: int, action: str, config: PatternConfig
) -> int:
    """Threshold after one signal; the counts already include it."""
    if action == "confirmed":
        drift = config.confirmed_delta
    else:
        drift = used * config.used_delta + ignored * config.ignored_delta
    moved = min(config.threshold_max, threshold + int(round(drift)))
    return max(moved, config.threshold_min, occurrences + 1)


def live_thresholds(
    signals: DataFrame,
    start_threshold: int = 12,
    config: PatternConfig = DEFAULT.patterns,
) -> DataFrame:
    """Threshold log of a stream of ``key, ts, seq, action`` signals.

    ``seen`` actions count an occurrence, the others adapt the threshold. Signals
    of one key must arrive in order across batches; inside a batch they are
    sorted. State is four numbers per key whatever the traffic.
    """

    def adapt(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        threshold, occurrences, used, ignored = (
            state.get if state.exists else (start_threshold, 0, 0, 0)
        )
        events = pd.concat(list(batches)).sort_values(["ts", "seq"])
        log = []
        for seq, action in zip(events["seq"], events["action"]):
            if action == "seen":
                occurrences += 1
                continue
            used += action == "used"
            ignored += action == "ignored"
            after = next_threshold(threshold, occurrences, used, ignored, action, config)
            log.append((key[0], seq, action, threshold, after))
            threshold = after
        state.update((int(threshold), int(occurrences), int(used), int(ignored)))
        yield pd.DataFrame(log, columns=["key", "seq", "action", "before", "after"])

    return signals.groupBy("key").applyInPandasWithState(
        adapt, THRESHOLD_ROWS, THRESHOLD_STATE, "append", GroupStateTimeout.NoTimeout
    )


NOTICE_STATE = "reason string, at_ms long, done boolean"
NOTICE_ROWS = "fragment_id string, event string, reason string, at timestamp"


def live_quarantine(
    events: DataFrame,
    lateness: str = "1 hour",
    config: QuarantineConfig = DEFAULT.quarantine,
) -> DataFrame:
    """Quarantine as keyed state with an event-time timer.

    Input: ``fragment_id, action, reason, ts`` with actions quarantine, resolve and
    release. Output: one ``notice`` per row still open after the waiting time, and
    ``resolve``/``release`` rows. A second quarantine of a live row is ignored.
    """
    wait_ms = int(config.notify_after_hours * 3_600_000)

    def track(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            reason, at_ms, done = state.get
            if not done:
                out.append((key[0], "notice", reason, pd.Timestamp(at_ms + wait_ms, unit="ms")))
            state.update((reason, at_ms, True))
        else:
            rows = pd.concat(list(batches)).sort_values("ts")
            for action, reason, ts in zip(rows["action"], rows["reason"], rows["ts"]):
                if action == "quarantine" and not state.exists:
                    state.update((reason, int(ts.timestamp() * 1000), False))
                elif action == "resolve" and state.exists:
                    first, at_ms, _ = state.get
                    state.update((first, at_ms, True))
                    out.append((key[0], "resolve", reason, ts))
                elif action == "release" and state.exists:
                    state.remove()
                    out.append((key[0], "release", reason, ts))
            if state.exists and not state.get[2]:
                due = state.get[1] + wait_ms
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["fragment_id", "event", "reason", "at"])

    return (
        events.withWatermark("ts", lateness)
        .groupBy("fragment_id")
        .applyInPandasWithState(
            track, NOTICE_ROWS, NOTICE_STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def notify_sink(
    notices: DataFrame, notify: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand notices to a callback per batch; a failing callback does not stop the stream."""

    def send(batch: DataFrame, epoch: int) -> None:
        try:
            notify(batch.where("event = 'notice'"), epoch)
        except Exception as error:  # the callback is foreign code
            print(f"notification callback failed in batch {epoch}: {error}")

    return (
        notices.writeStream.foreachBatch(send)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def gated_ingest(
    incoming: DataFrame, archive_path: str, rejected_path: str, checkpoint: str,
    config: EngineConfig = DEFAULT,
) -> StreamingQuery:
    """Pass a stream of fragments through the gate into the archive and a rejection log.

    Each batch overwrites its own ``epoch`` folder, so a repeated batch after a
    failure leaves the same rows.
    """

    def route(batch: DataFrame, epoch: int) -> None:
        guarded = guard(batch, config.gate).persist()
        admitted(guarded).write.mode("overwrite").parquet(f"{archive_path}/epoch={epoch}")
        rejections(guarded).write.mode("overwrite").parquet(f"{rejected_path}/epoch={epoch}")
        guarded.unpersist()

    return (
        incoming.writeStream.foreachBatch(route)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_trackers(occurrences: DataFrame) -> DataFrame:
    """Running frequency per pattern key (update mode)."""
    return occurrences.groupBy("key").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
