"""Adapters from the shared test tables to engine tables.

Every adapter covers its whole input table; values that the raw tables lack are
arithmetic on ids so that a SQL engine can derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions import words as W
from tessella.operators.archive import checksum
from tessella.scale import spread

EPOCH = "2024-01-01 00:00:00"
NOW = "2024-01-31 00:00:00"
OP_CYCLE = schemas.OPERATION_TYPES
HEAVY = ("documents", "conversations", "embeddings")  # text and vectors: work per row is large


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    out = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(out) if name in HEAVY else out


def fragment_id(number: Column) -> Column:
    return F.when(number % 10 == 0, F.format_string("F-%04d", number)).otherwise(
        F.format_string("D-%06d", number)
    )


def minutes_after_epoch(number: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + number * 60)


def parent_numbers(number: Column) -> Column:
    tree = F.array(F.floor((number - 1) / 2).cast("long"))
    extra = F.when(number % 5 == 0, F.array((number - 1).cast("long"))).otherwise(
        F.array().cast("array<long>")
    )
    return F.when(number > 0, F.array_distinct(F.concat(tree, extra))).otherwise(
        F.array().cast("array<long>")
    )


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    origins = W.strings(schemas.QUALITY_SOURCES)
    quality = (d * 37 % 101) / F.lit(100.0)
    origin = F.when(d % 9 < 8, F.get(origins, (d % 9).cast("int")))
    provenance = F.when(
        origin.isNotNull(),
        F.struct(
            F.array().cast(f"array<{schemas.EVALUATION}>").alias("evaluations"),
            quality.alias("final_quality"),
            origin.alias("final_source"),
            F.lit(None).cast("double").alias("consensus_score"),
            F.lit(None).cast("string").alias("consensus_method"),
        ),
    )
    conditions = F.struct(
        F.slice(W.lower_words(F.col("text")), 1, 2).alias("keywords"),
        F.lit(0.72).alias("semantic_threshold"),
        F.expr("cast(map() as map<string,boolean>)").alias("booleans"),
        F.array().cast("array<string>").alias("regex_patterns"),
        F.lit(False).alias("require_all_keywords"),
    )
    parity = F.when(d % 2 == 0, F.lit("Even")).otherwise(F.lit("odd"))
    out = table(spark, folder, "documents").select(
        fragment_id(d).alias("id"),
        d.alias("seq"),
        F.col("source").alias("shelf"),
        F.col("text").alias("content"),
        F.col("lang").alias("topic"),
        F.col("source").alias("source"),
        F.lit(None).cast("timestamp").alias("date"),
        quality.alias("quality"),
        provenance.alias("provenance"),
        F.when(d % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("author-"), d % 7)).alias("author"),
        F.array("lang", "source", parity).alias("tags"),
        F.expr("cast(map() as map<string,string>)").alias("extra"),
        conditions.alias("conditions"),
        F.transform(parent_numbers(d), fragment_id).alias("parents"),
        F.when(d % 11 == 0, F.lit("archived")).otherwise(F.lit("active")).alias("status"),
        minutes_after_epoch(d).alias("created_at"),
    )
    return out.withColumn(
        "checksum", checksum(F.col("id"), F.col("content"), F.col("created_at"))
    )


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, folder, "documents").select(
        fragment_id(d).alias("fragment_id"),
        d.alias("seq"),
        F.transform(parent_numbers(d), fragment_id).alias("parents"),
        F.when(d % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("m"), d % 4)).alias("model_id"),
        F.concat(F.lit("v"), d % 3).alias("model_version"),
        F.when(d % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("e"), d % 3)).alias(
            "evaluator_model_id"
        ),
        F.when(d % 9 < 8, F.get(W.strings(schemas.QUALITY_SOURCES), (d % 9).cast("int")))
        .otherwise(F.lit(""))
        .alias("quality_source"),
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    return (
        table(spark, folder, "documents")
        .select(
            d.alias("child_seq"),
            fragment_id(d).alias("child"),
            F.posexplode(parent_numbers(d)).alias("pos", "parent_seq"),
        )
        .select(
            fragment_id(F.col("parent_seq")).alias("parent"), "child", "pos", "parent_seq", "child_seq"
        )
    )


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Whole benchmark texts; every fourth has its first word once more."""
    q, text = F.col("item_id"), F.col("text")
    again = F.concat_ws(" ", text, F.get(W.words(text), F.lit(0)))
    return table(spark, folder, "benchmark").select(
        q.alias("qid"), F.when(q % 4 == 0, again).otherwise(text).alias("text")
    )


def fragment_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each fragment takes the stored vector number ``seq`` modulo the vector count."""
    vectors = table(spark, folder, "embeddings")
    count = vectors.count()
    docs = table(spark, folder, "documents").select(
        fragment_id(F.col("doc_id")).alias("id"),
        F.col("doc_id").alias("seq"),
        (F.col("doc_id") % count).alias("vec_id"),
    )
    return docs.join(vectors, "vec_id").select(
        "id", "seq", F.col("embedding").cast("array<double>").alias("vec")
    )


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    count = vectors.count()
    items = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("qid"), ((F.col("item_id") * 11 + 3) % count).alias("vec_id")
    )
    return items.join(vectors, "vec_id").select(
        "qid", F.col("embedding").cast("array<double>").alias("vec")
    )


def appeal_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each proposal takes the stored vector number ``seq`` modulo the vector count."""
    vectors = table(spark, folder, "embeddings")
    count = vectors.count()
    turns = table(spark, folder, "conversations").select(
        F.concat(F.lit("A-"), "conv_id", F.lit("-"), "turn").alias("id"),
        ((F.col("conv_id") * 1000 + F.col("turn")) % count).alias("vec_id"),
    )
    return turns.join(vectors, "vec_id").select("id", F.col("embedding").cast("array<double>").alias("vec"))


def appeals(spark: SparkSession, folder: str) -> DataFrame:
    """One proposal per conversation turn: its whole source text and the whole turn."""
    docs = table(spark, folder, "documents")
    count = docs.count()
    c, t = F.col("conv_id"), F.col("turn")
    turns = (
        table(spark, folder, "conversations")
        .withColumn("first_source", (c * 7 + t) % count)
        .withColumn("second_source", (c * 13) % count)
    )
    opening = docs.select(
        F.col("doc_id").alias("first_source"), F.col("text").alias("source_text")
    )
    status = F.get(W.strings(schemas.APPEAL_STATUSES), ((c + t) % 5).cast("int"))
    created = F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + c * 3600)
    ids = F.array(fragment_id(F.col("first_source")), fragment_id(F.col("second_source")))
    op_count = F.when(c % 23 == 0, F.lit(11)).otherwise((t % 3).cast("int"))
    cycle = W.strings(OP_CYCLE)
    ops = F.transform(
        F.when(op_count > 0, F.sequence(F.lit(1), op_count)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.struct(
            F.get(cycle, ((c + i) % 7).cast("int")).alias("op_type"),
            F.expr("cast(map() as map<string,string>)").alias("params"),
            F.lit("").alias("description"),
        ),
    )
    proposal = F.concat(
        F.col("source_text"),
        F.when(t % 3 == 0, F.lit(" perhaps maybe")).otherwise(F.lit("")),
        F.when(t % 4 == 0, F.lit(" not never")).otherwise(F.lit("")),
        F.lit(" "),
        F.col("text"),
    )
    return turns.join(opening, "first_source").select(
        F.concat(F.lit("A-"), c, F.lit("-"), t).alias("id"),
        (c * 1000 + t).alias("seq"),
        F.when(c % 17 == 0, F.concat(ids, F.array(F.lit("D-missing")))).otherwise(ids).alias("sources"),
        ops.alias("ops"),
        status.alias("status"),
        proposal.alias("proposed_content"),
        F.concat(F.lit("explanation "), c).alias("explanation"),
        created.alias("created_at"),
        F.when(
            status.isin(*schemas.DECIDED_APPEAL_STATUSES),
            F.timestamp_seconds(F.unix_timestamp(created) + t * 977),
        ).alias("resolved_at"),
    )


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    at = F.col("ts").cast("timestamp")
    return (
        table(spark, folder, "events")
        .where(F.col("event_type") == "error")
        .select(
            F.concat(F.lit("E-"), e).alias("fragment_id"),
            F.lit("scoring failed").alias("reason"),
            at.alias("quarantined_at"),
            F.when(e % 3 == 0, at).alias("notified_at"),
            (F.col("value") > 150).alias("resolved"),
            F.lit("").alias("resolution"),
        )
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Usage signals per pattern; the user number stands for the pattern key."""
    kind = (
        F.when(F.col("event_type") == "purchase", F.lit("confirmed"))
        .when(F.col("event_type") == "click", F.lit("used"))
        .when(F.col("event_type") == "view", F.lit("ignored"))
    )
    return (
        table(spark, folder, "events")
        .select(
            F.col("user_id").alias("key"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id").alias("seq"),
            kind.alias("action"),
        )
        .where(F.col("action").isNotNull())
    )


def feedback_trackers(spark: SparkSession, folder: str) -> DataFrame:
    """Starting state per key: pattern threshold and occurrences seen so far."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("key"))
        .agg(F.count_if(F.col("event_type") == "signup").alias("occurrences"))
        .withColumn("threshold", F.lit(12).cast("long"))
    )


def calibration(spark: SparkSession, folder: str) -> DataFrame:
    quality, toxic = F.col("l.quality"), F.col("l.toxic")
    label = (
        F.when((quality == 1) & (toxic == 0), F.lit("good"))
        .when((quality == 0) & (toxic == 0), F.lit("borderline"))
        .when((quality == 0) & (toxic == 1), F.lit("bad"))
        .otherwise(F.lit("junk"))
    )
    true_quality = (
        F.when(label == "good", 0.9).when(label == "borderline", 0.7).when(label == "bad", 0.3)
        .otherwise(0.08)
    )
    d = F.col("doc_id")
    return (
        table(spark, folder, "labels")
        .alias("l")
        .join(table(spark, folder, "documents").alias("d"), "doc_id")
        .select(
            fragment_id(d).alias("id"),
            d.alias("seq"),
            F.col("d.text").alias("content"),
            label.alias("ground_truth"),
            true_quality.alias("true_quality"),
            ((d * 37 % 101) / F.lit(100.0)).alias("claimed_quality"),
            F.col("d.lang").alias("category"),
        )
    )
