import random
import tempfile
import time
from datetime import datetime, timedelta

import pytest

from tessella.config import DEFAULT, QuarantineConfig
from tessella.streaming import keyed
from tessella.streaming.live import next_threshold

SIGNALS = "key long, ts timestamp, seq long, action string"
EVENTS = "fragment_id string, action string, reason string, ts timestamp"


def folder(name):
    return tempfile.mkdtemp(prefix=f"tessella-{name}-")


def fold(actions):
    threshold, seen, used, ignored, log = 12, 0, 0, 0, []
    for seq, action in actions:
        if action == "seen":
            seen += 1
            continue
        used += action == "used"
        ignored += action == "ignored"
        after = next_threshold(threshold, seen, used, ignored, action, DEFAULT.patterns)
        log.append((seq, action, threshold, after))
        threshold = after
    return log


@pytest.fixture
def provider(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def test_signals_in_any_order_and_a_restart(spark, provider):
    rng = random.Random(6)
    t0 = datetime(2024, 1, 1)
    plan = {k: [(i, rng.choice(["used", "ignored", "confirmed", "seen"])) for i in range(40)] for k in range(3)}
    every = [(k, t0 + timedelta(minutes=i), i, a) for k, acts in plan.items() for i, a in acts]
    rng.shuffle(every)
    source, sink, checkpoint = folder("src"), folder("out"), folder("ck")

    def run():
        stream = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 1).parquet(source)
        log = keyed.ordered_thresholds(stream, "2 hours")
        query = log.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).start()
        query.processAllAvailable()
        query.stop()

    for part in (every[:50], every[50:90]):
        spark.createDataFrame(part, SIGNALS).coalesce(1).write.mode("append").parquet(source)
    run()  # all within the lateness: nothing takes effect yet
    assert spark.read.schema("key long").parquet(sink).count() == 0
    spark.createDataFrame(every[90:], SIGNALS).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(99, t0 + timedelta(days=1), 0, "seen")], SIGNALS).coalesce(1).write.mode("append").parquet(source)
    run()
    got = {}
    for r in spark.read.parquet(sink).orderBy("key", "seq").collect():
        got.setdefault(r["key"], []).append((r["seq"], r["action"], r["before"], r["after"]))
    assert got == {k: fold(acts) for k, acts in plan.items()}


def test_notices_without_new_input_and_a_failing_notifier(spark, provider):
    source, path, checkpoint = folder("src"), folder("box"), folder("ck")
    t0 = datetime(2024, 1, 1)
    rows = [("a", "quarantine", "bad", t0), ("b", "quarantine", "bad", t0), ("b", "resolve", "fine", t0 + timedelta(seconds=1)), ("c", "quarantine", "bad", t0)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
    calls, taken = [], []

    def notify(due):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("mail server is away")
        taken.extend(r["fragment_id"] for r in due.collect())

    stream = spark.readStream.schema(EVENTS).parquet(source)
    config = QuarantineConfig(notify_after_hours=1 / 3600)
    query = keyed.outbox_sink(keyed.timed_quarantine(stream, config), path, notify, checkpoint, seconds=1)
    end = time.time() + 90
    while len(taken) < 2 and time.time() < end and query.isActive:
        time.sleep(1)
    query.stop()
    assert query.exception() is None
    assert sorted(taken) == ["a", "c"] and len(calls) >= 2
    stored = spark.read.parquet(f"{path}/outbox").select("fragment_id").collect()
    assert sorted(r[0] for r in stored) == ["a", "c"]  # once each
    assert keyed.waiting_notices(spark, path).count() == 0
