from pyspark.sql import functions as F

from tessella.operators import lookup as LK
from tessella.scale import shared_folder


def stored(spark, n=500, buckets=8):
    path = shared_folder(spark, "lookup")
    rows = spark.range(n).select(F.concat(F.lit("F-"), "id").alias("id"), (F.col("id") * 2).alias("twice"))
    LK.write_lookup(rows.unionByName(spark.createDataFrame([(None, 1)], "id string, twice long")), path, buckets)
    return path


def asked(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_found_and_unknown_ids(spark):
    path = stored(spark)
    got = {r["id"]: (r["found"], r["twice"]) for r in LK.lookup(spark, path, asked(spark, "F-3", "F-3", "nope", None), 8).collect()}
    assert got == {"F-3": (True, 6), "nope": (False, None), None: (False, None)}
    held = {r["id"]: r["found"] for r in LK.contains(spark, path, asked(spark, "F-499", "F-500"), 8).collect()}
    assert held == {"F-499": True, "F-500": False}
    assert LK.lookup(spark, path, asked(spark), 8).count() == 0


def test_a_short_list_opens_few_files(spark):
    path = stored(spark)
    found = LK.candidates(spark, path, asked(spark, "F-3"), 8)
    assert found.select(F.input_file_name()).distinct().count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "id_bucket#" in plan[plan.index("PartitionFilters") :].split("\n")[0]
    assert "id" in plan[plan.index("PushedFilters") :].split("\n")[0]


def test_a_long_list_joins(spark, monkeypatch):
    monkeypatch.setattr(LK, "LISTED_IDS", 3)
    got = LK.lookup(spark, stored(spark), asked(spark, *[f"F-{i}" for i in range(0, 1000, 50)]), 8)
    assert got.where("found").count() == 10 and got.count() == 20
