import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella import schemas
from tessella.operators import archive as AR
from tessella.operators import gate as GA
from tessella.sources.state import conform


def rows(spark, data):
    base = spark.createDataFrame(
        data, "id string, seq long, content string, quality double, tags array<string>, topic string"
    )
    created = F.to_timestamp(F.lit("2024-05-01 10:00:00.25"))
    full = base.withColumn("created_at", created).withColumn("status", F.lit("active")).withColumn(
        "checksum", AR.checksum(F.col("id"), F.col("content"), created)
    )
    return conform(full.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))), schemas.FRAGMENTS)


def with_source(df, source):
    p = F.struct(
        F.array().cast(f"array<{schemas.EVALUATION}>").alias("evaluations"),
        F.col("quality").alias("final_quality"), F.lit(source).alias("final_source"),
        F.lit(None).cast("double").alias("consensus_score"), F.lit(None).cast("string").alias("consensus_method"),
    )
    return df.withColumn("provenance", p)


def test_checksum_matches_python(spark):
    row = rows(spark, [("a", 1, "text", 0.5, [], "t")]).first()
    iso = "2024-05-01T10:00:00.250000+00:00"
    assert row["checksum"] == hashlib.sha256(f"a::text::{iso}".encode()).hexdigest()[:16]


def test_insert_verdicts(spark):
    stored = rows(spark, [("old", 0, "x", 0.5, [], "")])
    incoming = rows(
        spark,
        [("old", 1, "x", 0.5, [], ""), ("a", 2, "y" * 10001, 0.5, [], ""), ("a", 3, "y" * 10000, 0.5, [], ""),
         ("a", 4, "z", 0.5, [], ""), ("b", 5, "z", 0.5, [], "")],
    ).withColumn("checksum", F.when(F.col("id") == "b", "").otherwise(F.col("checksum")))
    got = {r["seq"]: r["reject_reason"] for r in AR.insert(incoming, stored).collect()}
    assert got == {1: "duplicate_id", 2: "content_too_long", 3: None, 4: "duplicate_id", 5: "missing_checksum"}


def test_filters(spark):
    f = rows(spark, [("a", 1, "Deep Sea", 0.9, ["Bio"], "x"), ("b", 2, "sky", 0.2, ["geo"], "y")])
    ids = lambda df: [r["id"] for r in df.orderBy("id").collect()]
    assert ids(AR.list_fragments(f, tags=["bio"])) == ["a"]
    assert ids(AR.list_fragments(f, topic="X")) == []
    assert ids(AR.list_fragments(f, tags=[])) == []
    assert ids(AR.search_by_keywords(f, ["sea"])) == ["a"]
    assert ids(AR.search_by_keywords(f, [])) == []
    assert ids(AR.search_by_quality(f, 0.9)) == ["a"]


def test_soft_delete_keeps_the_row(spark):
    f = rows(spark, [("a", 1, "x", 0.9, [], ""), ("b", 2, "y", 0.9, [], "")])
    got = {r["id"]: r["status"] for r in AR.soft_delete(f, f.where("id = 'a'").select("id")).collect()}
    assert got == {"a": "archived", "b": "active"}


def test_restore_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 5, "new"), ("b", 2, "x")], "id string, pos long, v string")
    assert {r["id"]: r["v"] for r in AR.restore(df).collect()} == {"a": "new", "b": "x"}


@pytest.mark.parametrize("ids, want", [(["F-0007", "F-12x", "D-9"], 13), (["x"], 1), ([], 1)])
def test_next_number(spark, ids, want):
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert AR.next_fragment_number(df).first()["next_id"] == want


@pytest.mark.parametrize(
    "quality, source, want",
    [(0.80, None, "accept"), (0.66, None, "accept_improved"), (0.64, None, "reject"),
     (0.94, "user_claimed", "accept_improved"), (0.95, "user_claimed", "accept"),
     (0.70, "user_claimed", "accept_improved"), (0.70, "independently_verified", "accept"),
     (0.60, "independently_verified", "reject")],
)
def test_guard(spark, quality, source, want):
    f = rows(spark, [("a", 1, "x", quality, ["t"], "")])
    f = with_source(f, source) if source else f
    assert GA.guard(f).first()["decision"] == want


def test_improved_row(spark):
    f = with_source(rows(spark, [("a", 1, "x", 0.70, ["t"], "top")]), "user_claimed")
    row = GA.admitted(GA.guard(f)).first()
    assert (row["id"], row["quality"], row["parents"], row["provenance"]) == ("a_improved", pytest.approx(0.85), ["a"], None)
    assert row["tags"] == ["t", "enhanced", "auto_improved"]


def test_overrides(spark):
    df = spark.createDataFrame([({"user_claimed": 0.5, "other": 1.0},), ({"other": 1.0},)], "m map<string,double>")
    assert [r[0] for r in df.select(GA.parse_overrides(F.col("m"))).collect()] == [{"user_claimed": 0.5}, None]


@pytest.mark.parametrize(
    "reply, whole, score, failed",
    [('{"score": 0.7, "confidence": 1}', False, 0.7, False), ('```json\n{"score": 0.9}\n```', False, 0.9, False),
     ("text\nmy Score is 0.65!", False, 0.65, True), ("value 0.4", False, 0.5, True), ("value 0.4", True, 0.4, True),
     ('{"confidence": 1}', False, 0.5, False), ('{"score": 7}', False, 1.0, False), ("", False, 0.5, True)],
)
def test_score_replies(spark, reply, whole, score, failed):
    df = spark.createDataFrame([(reply,)], "r string")
    got = df.select(GA.parse_score_reply(F.col("r"), whole).alias("p")).first()["p"]
    assert (got["score"], got["parse_failed"]) == (score, failed)
