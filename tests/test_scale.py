import itertools
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella import scale


def skewed(spark, n=3000):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(2, 200), i, rng.randrange(50)) for i in range(n)]
    return spark.createDataFrame(rows, "k long, i long, o long").cache()


def test_running_position_equals_row_number(spark):
    df = skewed(spark)
    got = scale.running_position(df, ["k"], ["o", "i"], "pos", buckets=7)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("o", "i")).cast("long"))
    assert got.exceptAll(want).count() == 0 and got.count() == df.count()


def test_order_buckets_split_a_hot_key(spark):
    df = spark.range(1000).withColumn("k", F.lit(1))
    sizes = [r["count"] for r in scale.with_order_bucket(df, "id", 8).groupBy("k", "_bucket").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 200


def test_skew_join_matches_plain_join(spark):
    many = skewed(spark)
    one = spark.range(1, 150).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how, target in itertools.product(("inner", "left", "left_semi", "left_anti"), (None, 100)):
        got = scale.skew_join(many, one, ["k"], how, ["i"], target)
        want = many.join(one, ["k"], how)
        assert got.select(want.columns).exceptAll(want).count() == 0
        assert got.count() == want.count()


def test_hot_keys(spark):
    assert [tuple(r) for r in scale.hot_keys(skewed(spark), ["k"], 300).collect()] == [(1, 5)]


def test_no_task_gets_much_more_than_its_target(spark):
    """One key owns 90 % of the rows."""
    many = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    hot = scale.hot_keys(many, ["k"], 500)
    groups = scale.salted(many, ["k"], ["id"], hot).groupBy("k", "_salt").count()
    assert groups.agg(F.max("count")).first()[0] < 1.3 * 500 and groups.agg(F.sum("count")).first()[0] == 20_000


def test_filter_once_and_exploded(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "i long, xs array<string>")
    assert sorted((r["i"], r["x"]) for r in scale.exploded(df, F.col("xs"), "x").collect()) == [(1, "a"), (1, "b")]
    doubled = df.withColumn("n", F.size("xs"))
    assert [r["i"] for r in scale.filter_once(doubled, F.col("n") == 2).collect()] == [1]


def test_small_side_uses_bound(spark):
    df = spark.range(10)
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(scale.small_side(df, 10)).lower()
    assert "broadcast" not in plan(scale.small_side(df, scale.BROADCAST_ROWS + 1)).lower()


def test_checkpoint_folder_comes_from_the_session(spark):
    assert scale.cut(spark.range(3)).count() == 3
    assert spark.sparkContext.getCheckpointDir()
