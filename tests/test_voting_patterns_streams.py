import random
import tempfile
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella import schemas
from tessella.config import EngineConfig, PatternConfig
from tessella.operators import genealogy as GE
from tessella.operators import patterns as PA
from tessella.operators import quarantine as QU
from tessella.operators import voting as VO
from tessella.sources.calibration_set import default_examples
from tessella.sources.state import conform
from tessella.streaming import live


def rows(spark, data):
    df = spark.createDataFrame(data, "id string, content string, quality double, origin string")
    p = F.struct(
        F.array().cast(f"array<{schemas.EVALUATION}>").alias("evaluations"), F.col("quality").alias("final_quality"),
        F.col("origin").alias("final_source"), F.lit(None).cast("double").alias("consensus_score"), F.lit(None).cast("string").alias("consensus_method"),
    )
    return df.withColumn("provenance", F.when(F.col("origin").isNotNull(), p))


def constant(*scores):
    return {f"a{i}": (lambda s: lambda c, q, b: F.lit(s).cast("double"))(s) for i, s in enumerate(scores)}


@pytest.mark.parametrize(
    "quality, origin, want",
    [(0.59, None, "reject"), (0.60, None, "vote"), (0.90, None, "vote"), (0.91, None, "accept"), (0.1, "user_claimed", "vote")],
)
def test_routes(spark, quality, origin, want):
    f = rows(spark, [("x", "c", quality, origin)])
    assert f.select(VO.route(F.col("quality"), F.col("provenance.final_source"))).first()[0] == want


@pytest.mark.parametrize(
    "scores, accepted, enough, consensus",
    [((0.9, 0.85, 0.1), True, True, True), ((0.9, 0.1), False, True, False), ((0.9, None, None), True, False, True), ((0.1, 0.2, 0.3), False, True, True)],
)
def test_votes(spark, scores, accepted, enough, consensus):
    row = VO.evaluate(rows(spark, [("x", "c", 0.7, None)]), constant(*scores)).first()
    assert (row["accepted"], row["enough"], row["consensus"]) == (accepted, enough, consensus)


def test_vetted_rows(spark):
    f = rows(spark, [("x", "c", 0.7, None), ("y", "c", 0.95, None), ("z", "c", 0.2, None)])
    at = F.to_timestamp(F.lit("2024-01-01"))
    got = {r["id"]: r for r in VO.accepted_fragments(VO.evaluate(f, constant(0.9, 0.8, 0.7)), at).collect()}
    assert set(got) == {"x_vetted", "y"}
    assert got["x_vetted"]["quality"] == pytest.approx(0.8)
    assert got["x_vetted"]["provenance"]["final_source"] == "majority_vote" and len(got["x_vetted"]["provenance"]["evaluations"]) == 3
    assert got["y"]["provenance"]["final_source"] == "independently_verified"


def test_noise_follows_the_seed(spark):
    f = rows(spark, [("x", "one two three four five six", 0.5, None)])
    row = VO.with_scores(f, VO.mock_scorers()).first()["scores"]
    for name, bias in (("agent-strict", -0.15), ("agent-balanced", 0.0), ("agent-generous", 0.15)):
        noise = (random.Random(zlib.crc32(f"one two three four five six::{name}".encode())).random() - 0.5) * 0.1
        assert row[name] == pytest.approx(round(round(0.5 + noise, 4) + bias, 4))


def test_calibration_rows(spark):
    ex = default_examples(spark)
    assert {r["ground_truth"]: r["n"] for r in VO.counts_by_label(ex).collect()} == {"good": 4, "bad": 4, "borderline": 4, "junk": 3}
    judged = VO.judge_examples(ex, constant(0.9, 0.9, 0.1))
    row = VO.calibration_summary(judged).first()
    assert (row["total"], row["correct"], row["false_positives"], row["false_negatives"]) == (15, 4, 7, 0)
    assert row["mean_agreement"] == pytest.approx(1 / 3)
    per = {r["agent"]: (r["accuracy"], r["own_accuracy"]) for r in VO.scorer_summary(judged).collect()}
    assert per["a0"] == pytest.approx((4 / 15, 4 / 15)) and per["a2"] == pytest.approx((4 / 15, 7 / 15))
    assert VO.stratified_sample(ex, 2).count() == 8


# -- genealogy ---------------------------------------------------------------------


def graph(spark, parents):
    n = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(parents.items())], "fragment_id string, seq long, parents array<string>")
    return n, GE.known_edges(n)


def brute_walk(parents, start):
    """Depth-first order over the parents, with least distances."""
    order, far = [], {start: 0}

    def visit(v):
        if v not in order:
            order.append(v)
            for p in parents[v]:
                visit(p)

    visit(start)
    queue = [start]
    for v in queue:
        for p in parents[v]:
            if p not in far:
                far[p] = far[v] + 1
                queue.append(p)
    return order, far


def test_walks_of_random_histories(spark):
    rng = random.Random(9)
    parents = {0: []}
    for i in range(1, 60):
        near = [i - 1] if rng.random() < 0.7 else rng.sample(range(i), min(i, rng.randint(0, 3)))
        parents[i] = near
    rows = [(f"n{i}", i, [f"n{p}" for p in ps]) for i, ps in parents.items()]
    nodes = spark.createDataFrame(rows, "fragment_id string, seq long, parents array<string>")
    edges = GE.known_edges(nodes)
    depth = {}
    for i, ps in parents.items():
        depth[i] = max((depth[p] + 1 for p in ps), default=0)
    assert {r[0]: r[1] for r in GE.depths(nodes, edges).collect()} == {f"n{i}": d for i, d in depth.items()}
    starts = [59, 40, 0]
    asked = spark.createDataFrame([(f"n{i}",) for i in starts], "start string")
    got = GE.lineage(asked, nodes, edges).orderBy("start", "number").collect()
    full = {r["start"]: r for r in GE.version_records(asked, nodes, edges).collect()}
    for s in starts:
        order, far = brute_walk(parents, s)
        own = [r for r in got if r["start"] == f"n{s}"]
        assert [r["fragment_id"] for r in own] == [f"n{v}" for v in order[::-1]]
        assert {r["fragment_id"]: r["distance"] for r in own} == {f"n{v}": d for v, d in far.items()}
        children = {v: [c for c, ps in parents.items() if v in ps] for v in parents}
        assert full[f"n{s}"]["ancestors"] == [f"n{v}" for v in order]
        assert full[f"n{s}"]["descendants"] == [f"n{v}" for v in brute_walk(children, s)[0]]


def test_a_long_history_takes_few_rounds(spark, monkeypatch):
    rounds, plain = [], GE.cut
    monkeypatch.setattr(GE, "cut", lambda df: rounds.append(1) or plain(df))
    n = 100_000
    ids = spark.range(n).select(F.col("id").cast("string").alias("fragment_id"))
    edges = spark.range(1, n).select((F.col("id") - 1).cast("string").alias("parent"), F.col("id").cast("string").alias("child"), F.lit(0).alias("pos"))
    got = GE.depths(ids, edges)
    assert got.where("depth <> cast(fragment_id as int)").count() == 0 and got.count() == n
    assert len(rounds) < 30


def test_depth_ancestors_and_cycles(spark):
    n, e = graph(spark, {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["c", "gone"], "x": ["y"], "y": []})
    assert {r[0]: r[1] for r in GE.depths(n, e).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "x": 0, "y": 0}
    start = spark.createDataFrame([("d",), ("nope",)], "start string")
    assert {r["fragment_id"] for r in GE.ancestors(start, n, e).collect()} == {"a", "b", "c", "d"}
    assert {r["fragment_id"] for r in GE.ancestors(start, n, e, 1).collect()} == {"c", "d"}
    assert {(r["start"], r["fragment_id"]) for r in GE.lineage(start, n, e).collect()} >= {("nope", "nope"), ("d", "a")}
    assert not GE.has_cycle(n, e)
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "parent string, child string")
    assert GE.has_cycle(n, loop) and {r[0] for r in GE.cycle_members(n, loop).collect()} == {"b", "c"}
    assert {r[0] for r in GE.leaves(n, e).collect()} == {"d", "x", "y"}


# -- patterns ----------------------------------------------------------------------


def test_code_patterns():
    code = "import os, sys\nfrom a import b\nLIMIT = 3\nx = 1\ndef f(a):\n    return a\n\nclass K:\n    y = 1\n    z = 2\ndef g(): pass\n"
    got = {(t, n) for t, n, _, _ in PA.python_patterns(code)}
    assert got == {("library", "os"), ("library", "sys"), ("library", "a.b"), ("constant", "LIMIT"), ("function", "f"), ("function", "K")}
    assert PA.python_patterns("def broken(:") == []


def test_scan_documents_auto(spark):
    texts = spark.createDataFrame(
        [(1, "ctx", "import os\n\ndef run(x):\n    # note\n    return x\n"), (2, "ctx", "The quick brown fox jumps over the lazy dog near banks.")],
        "seq long, context string, content string",
    )
    assert {(r["type"], r["seq"]) for r in PA.scan_documents(texts, "auto").collect()} == {("function", 1), ("library", 1), ("phrase", 2)}


def test_similar_patterns_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{'x' * (i % 5)}{i}" for i in range(24)]
    archive = [(f"f{i}", i, " ".join(rng.sample(vocabulary, rng.randrange(1, 22))), rng.choice([0.5, 0.95])) for i in range(120)]
    archive += [(f"c{i}", 200 + i, " ".join(vocabulary[:12]), 0.95 if i > 3 else 0.5) for i in range(30)]
    patterns = [(f"k{i}", " ".join(rng.sample(vocabulary, rng.randrange(3, 20)))) for i in range(60)] + [("hot", " ".join(vocabulary[:12]))]
    f = conform(spark.createDataFrame(archive, "id string, seq long, content string, quality double"), schemas.FRAGMENTS)
    p = spark.createDataFrame(patterns, "key string, content string")
    want = set()
    for key, text in patterns:
        words, scored = set(text.split()), []
        for _, seq, content, quality in archive:
            other = set(content.split())
            scored.append((-len(words & other) / min(len(words), len(other)), seq, quality))
        top = sorted(s for s in scored if -s[0] >= 0.35)[:3]
        if any(q >= 0.8 and -s >= 0.9 for s, _, q in top):
            want.add(key)
    assert {r["key"] for r in PA.similar_stored(p, f).collect()} == want


def test_similar_patterns_in_blocks_without_a_shuffle_of_stored_words(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(30)]
    archive = [(f"f{i}", i, " ".join(rng.sample(vocabulary, rng.randrange(1, 28))), 0.95) for i in range(60)]
    f = conform(spark.createDataFrame(archive, "id string, seq long, content string, quality double"), schemas.FRAGMENTS)
    p = spark.createDataFrame([(f"k{i}", " ".join(rng.sample(vocabulary, rng.randrange(3, 16)))) for i in range(40)], "key string, content string")
    whole = PA.similar_stored(p, f)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "hashpartitioning(set_id" not in plan
    want = {r["key"] for r in whole.collect()}
    monkeypatch.setattr(PA, "PATTERN_ROWS", 9)
    assert want and {r["key"] for r in PA.similar_stored(p, f).collect()} == want


def test_candidates_emit_each_due_occurrence(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa."
    texts = spark.createDataFrame([(i, "ctx", text) for i in range(5)], "seq long, context string, content string")
    empty = conform(spark.createDataFrame([("n", 0, "other words", 0.9)], "id string, seq long, content string, quality double"), schemas.FRAGMENTS)
    config = EngineConfig(patterns=PatternConfig(base_thresholds={"phrase": 3}))
    due = PA.candidates(PA.extract_phrases(texts), empty, config)
    assert sorted(r["occurrence"] for r in due.collect()) == [3, 4, 5]
    new = PA.certify(due, empty, config).collect()
    assert len(new) == 1 and new[0]["id"].startswith("R-") and new[0]["seq"] == 2


def fold(events, start, occurrences):
    thr, used, ignored = start, 0, 0
    for action in events:
        used += action == "used"
        ignored += action == "ignored"
        drift = -1 if action == "confirmed" else used * -0.5 + ignored * 0.3
        thr = max(1, min(30, thr + int(round(drift))))
        thr = occurrences + 1 if thr <= occurrences else thr
    return thr


@pytest.mark.parametrize("buckets", [2, 9])
def test_threshold_fold_equals_one_by_one(spark, buckets):
    rng = random.Random(buckets)
    t0, events, want, states = datetime(2024, 1, 1), [], {}, []
    for key in range(8):
        actions = rng.choices(["used", "ignored", "confirmed"], weights=[1, rng.choice([1, 4]), 1], k=400 if key == 0 else 20)
        occ = rng.randrange(0, 40)
        states.append((key, 12, occ))
        want[key] = fold(actions, 12, occ)
        events += [(key, t0 + timedelta(minutes=i), i, a) for i, a in enumerate(actions)]
    rng.shuffle(events)
    ev = spark.createDataFrame(events, "key long, ts timestamp, seq long, action string")
    st = spark.createDataFrame(states + [(99, 7, 0)], "key long, threshold long, occurrences long")
    got = {r["key"]: r["threshold"] for r in PA.adapt_thresholds(ev, st, buckets=buckets).collect()}
    assert got == {**want, 99: 7}


# -- quarantine --------------------------------------------------------------------


def test_quarantine_alerts(spark):
    now = F.to_timestamp(F.lit("2024-01-03"))
    at = F.to_timestamp(F.lit("2024-01-01"))
    make = lambda n: spark.range(n).select(F.concat(F.lit("q"), "id").alias("fragment_id"), F.lit("r").alias("reason"), at.alias("quarantined_at"), F.lit(None).cast("timestamp").alias("notified_at"), (F.col("id") % 2 == 0).alias("resolved"))
    kinds = lambda df: [(r["severity"], r["metric"], r["value"]) for r in QU.alerts(df, now).collect()]
    assert kinds(make(100)) == [("critical", "quarantine_size", 100), ("warning", "pending_notifications", 50)]
    assert kinds(make(50))[0] == ("warning", "quarantine_size", 50)
    assert kinds(make(1)) == [("ok", "quarantine_size", 1)]
    assert QU.pending_notifications(QU.mark_notified(make(4), now), now).count() == 0


# -- streams -----------------------------------------------------------------------


def test_stream_thresholds_equal_the_fold(spark):
    rng = random.Random(4)
    t0, folder = datetime(2024, 1, 1), tempfile.mkdtemp(prefix="tessella-src-")
    plan = {k: rng.choices(["used", "ignored", "confirmed"], k=30) for k in range(4)}
    schema = "key long, ts timestamp, seq long, action string"
    for part in range(3):
        rows_ = [(k, t0 + timedelta(minutes=i), i, a) for k, acts in plan.items() for i, a in enumerate(acts) if i // 10 == part]
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = live.live_thresholds(stream).writeStream.format("memory").queryName("thr").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    last = {r["key"]: r["after"] for r in spark.sql("SELECT key, max_by(after, seq) AS after FROM thr GROUP BY key").collect()}
    assert last == {k: fold(a, 12, 0) for k, a in plan.items()}


def test_stream_quarantine_timer(spark):
    folder, t0 = tempfile.mkdtemp(prefix="tessella-src-"), datetime(2024, 1, 1)
    schema = "fragment_id string, action string, reason string, ts timestamp"
    batches = [
        [("a", "quarantine", "bad", t0), ("b", "quarantine", "bad", t0), ("b", "resolve", "fine", t0 + timedelta(hours=2))],
        [("z", "quarantine", "late", t0 + timedelta(hours=40))],
        [("z2", "quarantine", "late", t0 + timedelta(hours=41))],
    ]
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = live.live_quarantine(stream).writeStream.format("memory").queryName("notices").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["fragment_id"], r["event"]) for r in spark.table("notices").collect()}
    assert ("a", "notice") in got and ("b", "resolve") in got and ("b", "notice") not in got


def test_gated_stream(spark):
    folder = tempfile.mkdtemp(prefix="tessella-src-")
    data = conform(spark.createDataFrame([("a", "x", 0.9), ("b", "y", 0.1), ("c", "z", 0.7)], "id string, content string, quality double"), schemas.FRAGMENTS)
    data = data.withColumn("tags", F.array().cast("array<string>"))
    data.write.mode("overwrite").parquet(folder)
    out, bad, ck = (tempfile.mkdtemp(prefix="tessella-out-") for _ in range(3))
    live.gated_ingest(spark.readStream.schema(data.schema).parquet(folder), out, bad, ck).awaitTermination(60)
    assert {r["id"] for r in spark.read.parquet(out).collect()} == {"a", "c_improved"}
    assert {r["id"] for r in spark.read.parquet(bad).collect()} == {"b"}


def test_certify_with_vote(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa."
    texts = spark.createDataFrame([(i, "ctx", text) for i in range(4)], "seq long, context string, content string")
    stored = conform(spark.createDataFrame([("n", 0, "other words", 0.9)], "id string, seq long, content string, quality double"), schemas.FRAGMENTS)
    config = EngineConfig(patterns=PatternConfig(base_thresholds={"phrase": 3}))
    due = PA.candidates(PA.extract_phrases(texts), stored, config)
    at = F.to_timestamp(F.lit("2024-01-01"))

    def vote(*scores):
        return lambda rows_: VO.accepted_fragments(VO.evaluate(rows_, constant(*scores)), at)

    yes = PA.certify(due, stored, config, vote(0.9, 0.8, 0.8)).collect()
    assert [r["id"].endswith("_vetted") for r in yes] == [True]
    improved = PA.certify(due, stored, config, vote(0.8, 0.8, 0.4)).collect()
    assert [(r["id"].endswith("_vetted_improved"), round(r["quality"], 4)) for r in improved] == [(True, 0.8167)]
    assert PA.certify(due, stored, config, vote(0.1, 0.2, 0.9)).count() == 0
