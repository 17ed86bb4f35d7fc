"""Point lookup: rows by id from a table whose files tell what ids they hold.

The table is split by the hash of the id and sorted by id; each file carries the smallest and
largest id of its row groups and a Bloom filter. A short list of ids reaches the reader as
partition and row filters, so it opens the buckets of these ids, and in them the row groups
that can hold one. A long list joins the buckets that it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.scale import small_side

BUCKETS = 64
# So many ids go to the reader as a list.
LISTED_IDS = 1000


def bucket_of(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def write_lookup(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store ``rows`` (with an ``id``) for lookups. NULL ids are stored, but never found."""
    placed = rows.withColumn("id_bucket", bucket_of("id", buckets))
    (
        placed.repartition("id_bucket")
        .sortWithinPartitions("id_bucket", "id")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#id", "true")
        .partitionBy("id_bucket")
        .parquet(path)
    )


def candidates(spark: SparkSession, path: str, ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Stored rows with one of the ids."""
    asked = ids.select("id").where(F.col("id").isNotNull()).distinct()
    few = [r[0] for r in asked.limit(LISTED_IDS + 1).collect()]
    wanted = [r[0] for r in asked.select(bucket_of("id", buckets)).distinct().collect()]  # BUCKETS at most
    rows = spark.read.parquet(path).where(F.col("id_bucket").isin(wanted)).drop("id_bucket")
    if len(few) <= LISTED_IDS:
        return rows.where(F.col("id").isin(few))
    return rows.join(small_side(asked), "id", "left_semi")


def lookup(spark: SparkSession, path: str, ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Each distinct id with ``found`` and the stored columns, NULL where it is not stored."""
    rows = candidates(spark, path, ids, buckets).withColumn("found", F.lit(True))
    asked = ids.select("id").distinct()
    return asked.join(rows, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def contains(spark: SparkSession, path: str, ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Membership: each distinct id with ``found``; no other column is read."""
    rows = candidates(spark, path, ids, buckets).select("id", F.lit(True).alias("found"))
    return ids.select("id").distinct().join(rows.distinct(), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))
