"""Layout of the stored keyword index: places instead of ids in postings, no texts shuffled twice."""

import pytest
from pyspark.sql import functions as F

from tessella.operators.keyword import bm25
from tessella.operators.stored_index import KeywordIndex
from tessella.scale import shared_folder

ROWS = "id string, seq long, content string"


def hits(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_postings_hold_places_and_texts_are_not_kept_twice(spark):
    index = KeywordIndex(spark, shared_folder(spark, "index"), buckets=2, slice_rows=70)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[j] for j in range(40) if (i * 7 + j * j) % 11 < 4 or j == i % 40) for i in range(150)]
    rows = spark.createDataFrame([(f"F-{i}", i // 2, t) for i, t in enumerate(texts)], ROWS)  # each seq twice
    plan = index._forward(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan  # no id comes twice
    index.rebuild(rows)
    assert dict(index._table("postings").dtypes)["docs"] == "array<bigint>"
    # ids 0..9 come twice in one batch: the first by seq stays
    again = [(f"F-{i}", 500 + i, f"w1 w{i} new") for i in range(10)] + [(f"F-{i}", 400 + i, f"w2 w2 w{i}") for i in range(10)]
    index.add(spark.createDataFrame(again, ROWS))
    index.remove(rows.where("seq % 5 = 4").select("id").unionByName(spark.createDataFrame([("F-3",), ("X",)], "id string")))
    living = {f"F-{i}": (i // 2, t) for i, t in enumerate(texts)} | {i: (s, t) for i, s, t in again[10:]}
    gone = {f"F-{i}" for i in range(150) if i // 2 % 5 == 4} | {"F-3"}
    left = [(i, s, t) for i, (s, t) in living.items() if i not in gone]
    queries = spark.createDataFrame([(1, "w1 w5"), (2, "w2 w2 w39 new"), (3, "new")], "qid long, text string")
    got = [(r["qid"], round(r["score"], 9), r["seq"]) for r in index.search(queries, 8).orderBy("qid", "rank").collect()]
    want = [(r["qid"], round(r["score"], 9), r["seq"]) for r in bm25(spark.createDataFrame(left, ROWS), queries, 8).orderBy("qid", "rank").collect()]
    assert got == want and len(want) == 16
    assert index.totals() == (len(left), sum(len(t.split()) for _, _, t in left))


def test_an_earlier_layout_is_not_read(spark):
    index = KeywordIndex(spark, shared_folder(spark, "index"), buckets=2)
    index._save("steps", spark.createDataFrame([(True, 1, 1)], "base boolean, docs long, length long"), 1)
    rows = spark.createDataFrame([("F-1", 1, "moon"), ("F-2", None, "moon tide")], ROWS)
    assert not index.exists()
    with pytest.raises(ValueError, match="earlier layout"):
        index.add(rows)
    index.rebuild(rows)
    index.remove(rows.where("seq IS NULL").select("id"))
    found = index.search(spark.createDataFrame([(1, "moon tide")], "qid long, text string"), 5)
    assert index.exists() and hits(found.withColumn("score", F.lit(0.0))) == [(1, 1, "F-1", 0.0)]
