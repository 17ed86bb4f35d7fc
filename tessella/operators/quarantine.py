"""Quarantine of rows that could not be judged: state, timers, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.config import DEFAULT, QuarantineConfig
from tessella.functions import words as W


def age_hours(since: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(since)) / 3_600_000_000


def needs_notice(now: Column, config: QuarantineConfig = DEFAULT.quarantine) -> Column:
    return (
        ~F.col("resolved")
        & F.col("notified_at").isNull()
        & (age_hours(F.col("quarantined_at"), now) >= config.notify_after_hours)
    )


def pending_notifications(
    entries: DataFrame, now: Column, config: QuarantineConfig = DEFAULT.quarantine
) -> DataFrame:
    return entries.where(needs_notice(now, config))


def mark_notified(
    entries: DataFrame, now: Column, config: QuarantineConfig = DEFAULT.quarantine
) -> DataFrame:
    """Stamp every row that is due; each row is stamped once."""
    return entries.withColumn(
        "notified_at", F.when(needs_notice(now, config), now).otherwise(F.col("notified_at"))
    )


def sizes(entries: DataFrame, now: Column, config: QuarantineConfig = DEFAULT.quarantine) -> DataFrame:
    return entries.agg(
        F.count(F.lit(1)).alias("quarantine_size"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
        F.count_if(needs_notice(now, config)).alias("pending_notifications"),
    )


def alerts(entries: DataFrame, now: Column, config: QuarantineConfig = DEFAULT.quarantine) -> DataFrame:
    """``severity, metric, value, message``; a single ``ok`` row when all is well."""
    total, pending = F.col("quarantine_size"), F.col("pending_notifications")
    limit = config.alert_threshold

    def alert(severity: str, metric: str, value: Column, *text) -> Column:
        parts = [p if isinstance(p, Column) else F.lit(p) for p in text]
        return F.struct(
            F.lit(severity).alias("severity"),
            F.lit(metric).alias("metric"),
            value.alias("value"),
            F.concat(*parts).alias("message"),
        )

    size = F.when(
        total >= limit * 2,
        alert("critical", "quarantine_size", total, "Quarantine has ", total.cast("string"),
              f" fragments (>{limit * 2}x threshold)"),
    ).when(
        total >= limit,
        alert("warning", "quarantine_size", total, "Quarantine has ", total.cast("string"),
              f" fragments (exceeds threshold of {limit})"),
    )
    waiting = F.when(
        pending > 0,
        alert("warning", "pending_notifications", pending, pending.cast("string"),
              " fragment(s) in quarantine >24h without admin review"),
    )
    fine = alert("ok", "quarantine_size", total, "Quarantine is healthy")
    raised = F.filter(F.array(size, waiting), lambda a: a.isNotNull())
    return (
        sizes(entries, now, config)
        .select(F.explode(F.when(F.size(raised) > 0, raised).otherwise(F.array(fine))).alias("a"))
        .select("a.*")
    )


def fold(log: DataFrame) -> DataFrame:
    """Current state from an event log ``fragment_id, action, at, seq, reason``.

    Actions are quarantine, notify, resolve and release. Only events after the
    last release count, a second quarantine of a live row is ignored. All steps
    are partial aggregates per id, so a busy id never gathers its events.
    """
    released = log.groupBy("fragment_id").agg(
        F.coalesce(F.max(F.when(F.col("action") == "release", F.col("seq"))), F.lit(-1)).alias("_cut")
    )
    from tessella.scale import skew_join

    live = skew_join(log, released, ["fragment_id"], "inner", ["seq"]).where(
        F.col("seq") > F.col("_cut")
    )

    def first(action: str, column: str) -> Column:
        hit = F.col("action") == action
        return F.min_by(F.when(hit, F.col(column)), F.when(hit, F.col("seq")))

    def last(action: str, column: str) -> Column:
        hit = F.col("action") == action
        return F.max_by(F.when(hit, F.col(column)), F.when(hit, F.col("seq")))

    return (
        live.groupBy("fragment_id")
        .agg(
            first("quarantine", "reason").alias("reason"),
            first("quarantine", "at").alias("quarantined_at"),
            first("notify", "at").alias("notified_at"),
            F.coalesce(F.bool_or(F.col("action") == "resolve"), F.lit(False)).alias("resolved"),
            F.coalesce(last("resolve", "reason"), F.lit("")).alias("resolution"),
        )
        .where(F.col("quarantined_at").isNotNull())
    )


def dump(entries: DataFrame, fragments: DataFrame) -> DataFrame:
    """JSON-ready rows; of the fragment only id, topic and quality are kept."""
    return entries.join(
        fragments.select(F.col("id").alias("fragment_id"), "topic", "quality"), "fragment_id", "left"
    )


def duration_since(since: Column, now: Column) -> Column:
    return W.duration_text((F.unix_micros(now) - F.unix_micros(since)) / 1_000_000)
