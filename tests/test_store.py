import tempfile

from pyspark.sql import functions as F

from tessella.engine import Engine
from tessella.scale import cut
from tessella.sources.state import TableStore


def fragment_rows(spark, data):
    return spark.createDataFrame(data, "id string, seq long, content string")


def contents(store):
    return {r["id"]: r["content"] for r in store.read("fragments").collect()}


def test_commits_overlay_the_base(spark):
    store = TableStore(spark, tempfile.mkdtemp(prefix="tessella-store-"))
    assert contents(store) == {}
    store.append("fragments", fragment_rows(spark, [("a", 1, "a0"), ("b", 2, "b0"), ("c", 3, "c0")]))
    store.append("fragments", fragment_rows(spark, [("a", 1, "a1"), ("d", 4, "d0")]))
    store.append("fragments", fragment_rows(spark, [("a", 1, "a2")]))
    store.append("fragments", fragment_rows(spark, [("b", 2, "")]), removed=True)
    want = {"a": "a2", "c": "c0", "d": "d0"}
    assert contents(store) == want
    store.compact("fragments")
    assert contents(store) == want
    assert spark.read.parquet(f"{store.root}/fragments").agg(F.max("base")).first()[0] == 1
    store.append("fragments", fragment_rows(spark, [("b", 2, "b9")]))
    assert contents(store) == {**want, "b": "b9"}


def test_small_commits_do_not_shuffle_the_base(spark):
    store = TableStore(spark, tempfile.mkdtemp(prefix="tessella-store-"))
    store.append("fragments", fragment_rows(spark, [("a", 1, "a0"), ("b", 2, "b0")]))
    store.append("fragments", fragment_rows(spark, [("a", 1, "a1")]))
    df = store.read("fragments")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "strategy=broadcast" in plan


def test_shelves_and_soft_delete(spark):
    engine = Engine(spark, tempfile.mkdtemp(prefix="tessella-engine-"))
    engine.create_shelf("one", "sea")
    engine.create_shelf("two")
    assert engine.drop_shelf("two") and not engine.drop_shelf("two")
    assert [r["name"] for r in engine.shelves().collect()] == ["one"]
    rows = spark.createDataFrame([("a", 1, "tide", 0.9, "one"), ("b", 2, "moon", 0.9, "one")], "id string, seq long, content string, quality double, shelf string")
    engine.ingest(rows)
    again = {r["id"]: r["reject_reason"] for r in engine.ingest(rows).collect()}
    assert again == {"a": "duplicate_id", "b": "duplicate_id"}
    engine.delete(spark.createDataFrame([("a",)], "id string"))
    assert {r["id"]: r["status"] for r in engine.fragments().collect()} == {"a": "archived", "b": "active"}
    hits = cut(engine.search_shelves(spark.createDataFrame([(1, "tide")], "qid long, text string")))
    assert [(r["shelf"], r["id"]) for r in hits.collect()] == [("one", "a")]


def test_pruning_removes_stored_appeals(spark):
    engine = Engine(spark, tempfile.mkdtemp(prefix="tessella-engine-"))
    engine.store.append(
        "appeals",
        spark.createDataFrame([("x", 1, "rejected"), ("y", 2, "draft")], "id string, seq long, status string").withColumn(
            "resolved_at", F.when(F.col("id") == "x", F.to_timestamp(F.lit("2024-01-01")))
        ),
    )
    assert engine.prune_appeals(F.to_timestamp(F.lit("2024-06-01"))) == 1
    assert [r["id"] for r in engine.appeals().collect()] == ["y"]


def rows_with_parents(spark, data):
    return spark.createDataFrame(
        data, "id string, content string, quality double, parents array<string>, shelf string"
    )


def test_parents_of_an_earlier_batch_are_kept(spark):
    from tessella.operators.genealogy import known_edges

    engine = Engine(spark, tempfile.mkdtemp(prefix="tessella-engine-"))
    engine.ingest(rows_with_parents(spark, [(f"p{i}", f"text {i}", 0.99, [], "main") for i in range(4)]))
    engine.ingest(rows_with_parents(spark, [("c0", "child", 0.99, ["p3", "p0"], "main")]))
    edges = {(r["parent"], r["child"]) for r in known_edges(engine.nodes()).collect()}
    assert edges == {("p3", "c0"), ("p0", "c0")}


def test_a_shelf_has_its_own_threshold(spark):
    engine = Engine(spark, tempfile.mkdtemp(prefix="tessella-engine-"))
    engine.create_shelf("strict", threshold=0.99)
    engine.create_shelf("loose", threshold=0.20)
    engine.ingest(
        rows_with_parents(spark, [("a", "x", 0.85, [], "strict"), ("b", "y", 0.25, [], "loose"), ("c", "z", 0.85, [], "main")])
    )
    assert {r["id"] for r in engine.fragments().collect()} == {"b", "c"}


def test_nodes_and_fragments_agree_after_approval(spark):
    engine = Engine(spark, tempfile.mkdtemp(prefix="tessella-engine-"))
    engine.ingest(rows_with_parents(spark, [("F-0001", "tide and moon", 0.99, [], "main")]))
    drafts = spark.createDataFrame(
        [("A-1", 1, ["F-0001"], "tide, moon and sun", "why")],
        "id string, seq long, sources array<string>, proposed_content string, explanation string",
    ).withColumn("ops", F.expr("cast(array() as array<struct<op_type:string,params:map<string,string>,description:string>>)"))
    engine.propose(drafts)
    ids = drafts.select("id")
    engine.submit(ids)
    new = engine.approve(ids).first()
    stored = engine.fragments().where(F.col("id") == new["id"]).first()
    node = engine.nodes().where(F.col("fragment_id") == new["id"]).first()
    assert stored["checksum"] == node["checksum"] and stored["seq"] == node["seq"]
    assert stored["seq"] > engine.fragments().where("id = 'F-0001'").first()["seq"]


def test_an_unreadable_table_is_not_an_empty_one(spark):
    from pathlib import Path

    import pytest
    from pyspark.errors import PySparkException

    root = tempfile.mkdtemp(prefix="tessella-store-")
    Path(root, "fragments").mkdir()
    with pytest.raises(PySparkException):
        TableStore(spark, root).append("fragments", fragment_rows(spark, [("a", 1, "a0")]))


def test_only_voting_rows_reach_the_scorers(spark):
    from tessella.operators.voting import evaluate

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(content):
        seen.add(1)
        return 0.9

    rows = spark.createDataFrame(
        [("a", "x", 0.1), ("b", "y", 0.99), ("c", "z", 0.8)], "id string, content string, quality double"
    ).withColumn("provenance", F.struct(F.lit("inherited").alias("final_source")))
    voted = evaluate(rows, {"one": lambda c, q, b: counted(c)}).collect()
    by_route = {r["id"]: r["route"] for r in voted}
    assert seen.value == sum(v == "vote" for v in by_route.values()) and len(set(by_route.values())) == 3
