import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions import lexicon as lx
from tessella.operators import appeals as AP
from tessella.operators import governance as GO
from tessella.sources.state import conform


def now():
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


def fragments(spark, data):
    df = spark.createDataFrame(data, "id string, seq long, content string, quality double, topic string, tags array<string>, author string")
    return conform(df, schemas.FRAGMENTS)


SOURCES = [
    ("s1", 1, "the quick brown fox jumps over it", 0.9, "fox", ["a"], "ann"),
    ("s2", 2, "lazy dogs sleep all day\nlong", 0.6, "dog", ["b", "a"], ""),
    ("F-0041", 3, "", 0.1, "", [], "bob"),
]


def appeals(spark, data):
    df = spark.createDataFrame(data, "id string, seq long, sources array<string>, proposed_content string, status string, n_ops int")
    ops = F.transform(F.sequence(F.lit(1), F.col("n_ops")), lambda i: F.struct(F.lit("merge").alias("op_type"), F.lit("").alias("description")))
    df = df.withColumn("ops", F.when(F.col("n_ops") > 0, F.transform(ops, lambda o: F.struct(o["op_type"].alias("op_type"), F.lit(None).cast("map<string,string>").alias("params"), o["description"].alias("description")))))
    df = df.withColumn("ops", F.coalesce("ops", F.array().cast(schemas.OPERATIONS)))
    return conform(df.withColumn("created_at", now()).withColumn("explanation", F.lit("why " * 30)), schemas.APPEALS)


def brute_metrics(proposal, sources):
    p = proposal.split()
    s = [w for t in sources for w in t.split()]
    ps, ss = set(p), set(s)
    cov = (1.0 if not ps else 0.0) if not ss else len(ps & ss) / len(ss)
    if not s:
        risk = 0.5 if p else 0.0
    else:
        ratio = len(p) / len(s)
        risk = min((ratio - 2) / 2 * 0.5, 0.5) if ratio > 2 else 0.0
        risk += 0.3 * len(ps - ss) / len(ps) if ps else 0.0
        risk = min(risk + (0.2 if ratio < 0.5 and len(s) > 5 else 0.0), 1.0)
    low = set(proposal.lower().split())
    vague = min(5 * sum(w in lx.HEDGES for w in low) / len(low), 1.0) if low else 0.0
    risk = min(risk + 0.15 * vague, 1.0)
    delta = len(p) - len(s)
    return delta, cov, risk, 0.3 * math.tanh(delta / max(len(s), 1)) + 0.4 * cov - 0.3 * risk


def test_metrics_against_brute_force(spark):
    rng = random.Random(11)
    pool = " ".join(s[2] for s in SOURCES).split() + ["maybe", "perhaps", "new", "words"]
    data = [(f"p{i}", i, rng.sample(["s1", "s2", "F-0041", "gone"], rng.randrange(4)), " ".join(rng.choices(pool, k=rng.randrange(60))), "draft", 1) for i in range(40)]
    got = AP.with_metrics(AP.dossier(appeals(spark, data), fragments(spark, SOURCES))).collect()
    texts = {s[0]: s[2] for s in SOURCES}
    for row in got:
        want = brute_metrics(row["proposed_content"], [texts[s] for s in row["sources"] if s in texts])
        assert (row["delta_token"], row["coverage"], row["risk"], row["aggregate_score"]) == pytest.approx(want)


def test_diff_and_reordering(spark):
    text = "lazy dogs sleep all day\nlong then THE QUICK brown fox jumps over it"
    a = appeals(spark, [("x", 1, ["s1", "s2"], text, "draft", 0), ("y", 2, ["s1"], "same", "draft", 0)])
    rows = {r["id"]: r for r in AP.with_diff(AP.with_metrics(AP.dossier(a, fragments(spark, SOURCES)))).collect()}
    assert rows["x"]["reordered"] == [0, 1] and rows["y"]["reordered"] == []
    assert rows["x"]["added"] == ["QUICK", "THE", "then"] and rows["x"]["removed"] == ["quick", "the"]
    assert [m["line_num"] for m in rows["x"]["modified"]] == [1, 2]


def test_insert_limits(spark):
    data = [(f"n{i}", i, [], "", "draft", 11 if i == 3 else 1) for i in range(25)] + [("n1", 30, [], "", "draft", 1)]
    existing = appeals(spark, [("e1", 1, [], "", "draft", 0), ("e2", 2, [], "", "approved", 0), ("n0", 3, [], "", "expired", 0)])
    got = {(r["id"], r["seq"]): r["reject_reason"] for r in AP.insert(appeals(spark, data), existing).collect()}
    assert got[("n0", 0)] == "duplicate_id" and got[("n1", 30)] == "duplicate_id" and got[("n3", 3)] == "too_many_ops"
    assert sum(v is None for v in got.values()) == 19
    assert got[("n24", 24)] == "too_many_active"


def test_status_changes(spark):
    a = appeals(spark, [("x", 1, [], "", "draft", 0), ("y", 2, [], "", "draft", 0)])
    changes = spark.createDataFrame([("x", "pending_user_approval", 1), ("x", "approved", 2), ("y", "expired", 1)], "id string, status string, change_seq long")
    got = {r["id"]: (r["status"], r["resolved_at"] is not None) for r in AP.set_status(a, changes, now()).collect()}
    assert got == {"x": ("approved", True), "y": ("expired", False)}


def test_prune_by_age_then_by_count(spark):
    base = appeals(spark, [(f"c{i}", i, [], "", "rejected", 0) for i in range(6)] + [("z", 9, [], "", "expired", 0), ("d", 10, [], "", "draft", 0)])
    aged = base.withColumn("resolved_at", F.when(F.col("status") == "rejected", F.timestamp_seconds(F.unix_timestamp(now()) - F.col("seq") * 86400 * 10)))
    pruned = lambda **k: sorted(r["id"] for r in AP.prune(aged, now(), **k).where("pruned").collect())
    assert pruned() == ["c4", "c5"]
    assert pruned(retention_days=1000, max_generations=4) == ["c4", "c5", "z"]
    assert pruned(retention_days=1000) == []


def test_merge_provenance_and_quality_text(spark):
    a = appeals(spark, [("x", 1, ["s1", "s2", "gone"], "p", "draft", 0), ("y", 2, [], "p", "draft", 0)])
    d = AP.dossier(a, fragments(spark, SOURCES))
    rows = {r["id"]: r for r in GO.merged_metadata(d).collect()}
    assert (rows["x"]["m_topic"], rows["x"]["m_tags"], rows["x"]["m_quality"], rows["x"]["m_author"]) == ("dog | fox", ["a", "b"], 0.75, "ann")
    assert (len(rows["y"]["m_topic"]), rows["y"]["m_quality"], rows["y"]["m_author"]) == (60, 0.0, "system")
    text = {r["id"]: r["t"] for r in d.select("id", GO.quality_text(d).alias("t")).collect()}
    assert text["y"] == "No source fragments available."
    assert text["x"] == "Source fragments: 2\nQuality range: 0.60 - 0.90\nMean quality: 0.750\nQuality sources: {'unknown': 2}"


def test_side_by_side_is_a_unified_diff(spark):
    a = appeals(spark, [("x", 1, ["s1", "s2"], "lazy dogs sleep all day\nshort", "draft", 0)])
    got = GO.with_side_by_side(AP.dossier(a, fragments(spark, SOURCES))).first()["side_by_side"]
    old = (SOURCES[0][2] + "\n" + SOURCES[1][2]).splitlines()
    want = "\n".join(difflib.unified_diff(old, ["lazy dogs sleep all day", "short"], fromfile="original_sources", tofile="proposed_content", lineterm=""))
    assert got == want


def test_side_by_side_unpacks_one_pair_at_a_time(spark):
    """Texts come as Arrow, and a long diff is cut as the whole of it would be."""
    lines = [f"line {i} " + "x" * (i % 50) for i in range(300)]
    a = appeals(spark, [("x", 1, ["s1", "s2"], "\n".join(lines), "draft", 0)])
    out = GO.with_side_by_side(AP.dossier(a, fragments(spark, SOURCES)))
    old = (SOURCES[0][2] + "\n" + SOURCES[1][2]).splitlines()
    want = "\n".join(difflib.unified_diff(old, lines, fromfile="original_sources", tofile="proposed_content", lineterm=""))
    assert len(want) > 2000 and out.first()["side_by_side"] == want[:2000]
    assert GO.side_by_side.evalType == 250  # an Arrow function, not one over pandas objects


def test_approve_numbers_and_refusals(spark):
    a = appeals(spark, [("x", 2, ["s1"], "px", "pending_user_approval", 0), ("y", 1, ["s2"], "py", "pending_user_approval", 0), ("z", 3, [], "pz", "draft", 0)])
    new, nodes, refused = GO.approve(a, a.select("id"), fragments(spark, SOURCES), now())
    got = {r["appeal_id"]: (r["id"], r["parents"], r["quality"]) for r in new.collect()}
    assert got == {"y": ("F-0042", ["s2"], 0.6), "x": ("F-0043", ["s1"], 0.9)}
    assert {r["quality_source"] for r in nodes.collect()} == {"governance_promotion"}
    assert [r["id"] for r in refused.collect()] == ["z"]


def test_best_parent_and_rollback(spark):
    f = fragments(spark, SOURCES + [("k", 4, "c", 0.5, "", [], "")])
    n = spark.createDataFrame([("k", ["s2", "s1", "gone"]), ("s1", []), ("q", ["gone", "lost"])], "fragment_id string, parents array<string>")
    assert {r[0]: r[1] for r in GO.best_parent(n, f).collect()} == {"k": "s1", "q": "lost"}
    archive, answer = GO.rollback(f, n, spark.createDataFrame([("k",), ("s1",), ("q",)], "id string"))
    assert {r["id"]: r["previous"] for r in answer.collect()} == {"k": "s1", "s1": None, "q": None}
    assert {r["id"] for r in archive.where("status = 'archived'").collect()} == {"k"}


def test_statistics_ignore_negative_times(spark):
    a = appeals(spark, [("x", 1, [], "", "approved", 0), ("y", 2, [], "", "rejected", 0), ("z", 3, [], "", "draft", 0)])
    a = a.withColumn("resolved_at", F.when(F.col("id") == "x", F.timestamp_seconds(F.unix_timestamp("created_at") + 90)).when(F.col("id") == "y", F.timestamp_seconds(F.unix_timestamp("created_at") - 5)))
    row = GO.statistics(a).first()
    assert (row["total_appeals"], row["avg_seconds"], row["avg_text"], row["quarantine_size"]) == (3, 90.0, "1m 30s", 0)


def test_pros_cons_fallbacks(spark):
    df = spark.createDataFrame([(0, 0.5, 0.3, 0.5, [], [])], "delta_token int, coverage double, risk double, aggregate_score double, added array<string>, removed array<string>")
    pros, cons = AP.governance_pros_cons()
    row = df.select(pros.alias("p"), cons.alias("c")).first()
    assert (row["p"], row["c"]) == (["No significant advantages identified"], ["No significant concerns identified"])
