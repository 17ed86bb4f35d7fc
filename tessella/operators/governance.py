"""Approval workflow in batches: merged metadata, promotion, reports, statistics."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.config import DEFAULT, EngineConfig
from tessella.functions import words as W
from tessella.operators.appeals import (
    dossier,
    explanation_text,
    governance_pros_cons,
    with_diff,
    with_metrics,
)
from tessella.operators.archive import checksum, next_fragment_number, soft_delete
from tessella.scale import running_position

EMBEDDING_MODEL = "all-MiniLM-L6-v2"


def merged_metadata(dossiers: DataFrame) -> DataFrame:
    """Add ``m_topic, m_tags, m_quality, m_author`` from the resolved sources."""

    def distinct(field: str) -> Column:
        values = F.filter(F.transform("cited", lambda s: s[field]), lambda v: v != "")
        return F.array_sort(F.array_distinct(values))

    topics, authors = distinct("topic"), distinct("author")
    total = F.aggregate("cited", F.lit(0.0), lambda acc, s: acc + s["quality"])
    return (
        dossiers.withColumn(
            "m_topic",
            F.when(F.size(topics) > 0, F.array_join(topics, " | ")).otherwise(
                F.substring("explanation", 1, 60)
            ),
        )
        .withColumn(
            "m_tags",
            F.array_sort(F.array_distinct(F.flatten(F.transform("cited", lambda s: s["tags"])))),
        )
        .withColumn("m_quality", F.round(total / F.greatest(F.size("cited"), F.lit(1)), 4))
        .withColumn(
            "m_author",
            F.when(F.size(authors) > 0, F.array_join(authors, ", ")).otherwise(F.lit("system")),
        )
    )


def provenance_summary(dossiers: DataFrame) -> DataFrame:
    """Add count, min, max, mean quality and the distinct quality sources."""
    qualities = F.transform("cited", lambda s: s["quality"])
    sources = F.filter(
        F.transform("cited", lambda s: s["provenance"]["final_source"]), lambda v: v.isNotNull()
    )
    n = F.size("cited")
    total = F.aggregate(qualities, F.lit(0.0), lambda acc, q: acc + q)
    return (
        dossiers.withColumn("n_sources", n)
        .withColumn("min_quality", F.round(F.array_min(qualities), 4))
        .withColumn("max_quality", F.round(F.array_max(qualities), 4))
        .withColumn("mean_quality", F.when(n > 0, F.round(total / n, 4)))
        .withColumn("quality_sources", F.array_sort(F.array_distinct(sources)))
    )


def quality_text(dossiers: DataFrame) -> Column:
    """Text summary of source qualities with a histogram of their origins."""
    qualities = F.transform("cited", lambda s: s["quality"])
    origins = F.transform(
        "cited", lambda s: F.coalesce(s["provenance"]["final_source"], F.lit("unknown"))
    )
    n = F.size("cited")
    mean = F.aggregate(qualities, F.lit(0.0), lambda acc, q: acc + q) / n
    histogram = F.array_join(
        F.transform(
            F.array_distinct(origins),
            lambda o: F.concat(
                F.lit("'"), o, F.lit("': "), F.size(F.filter(origins, lambda x: x == o)).cast("string")
            ),
        ),
        ", ",
    )
    return F.when(n == 0, F.lit("No source fragments available.")).otherwise(
        F.concat(
            F.lit("Source fragments: "), n.cast("string"),
            F.lit("\nQuality range: "), W.fixed(F.array_min(qualities), 2),
            F.lit(" - "), W.fixed(F.array_max(qualities), 2),
            F.lit("\nMean quality: "), W.fixed(mean, 3),
            F.lit("\nQuality sources: {"), histogram, F.lit("}"),
        )
    )


def model_provenance(dossiers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Model fields of every source that has a node with a model."""
    known = nodes.where(F.col("model_id") != "").select(
        F.col("fragment_id").alias("source_id"), "model_id", "model_version",
        "evaluator_model_id", "quality_source",
    )
    links = dossiers.select(
        "id", F.explode(F.transform("cited", lambda s: s["source_id"])).alias("source_id")
    ).distinct()
    from tessella.scale import skew_join

    return skew_join(links, known, ["source_id"], "inner", ["id"])


@F.arrow_udf(T.StringType())
def side_by_side(source: pa.Array, proposed: pa.Array) -> pa.Array:
    """Unified diff of two texts, first 2000 characters; one pair of texts is unpacked at a time."""
    return pa.array((_diff(s.as_py(), p.as_py()) for s, p in zip(source, proposed)), pa.string())


def _diff(source: str, proposed: str) -> str:
    lines = difflib.unified_diff(
        source.splitlines(), proposed.splitlines(), fromfile="original_sources", tofile="proposed_content", lineterm=""
    )
    kept, size = [], 0
    for line in lines:
        kept.append(line)
        size += len(line) + 1
        if size > 2000:
            break
    return "\n".join(kept)[:2000]


def with_side_by_side(dossiers: DataFrame) -> DataFrame:
    source = F.array_join(F.transform("cited", lambda s: s["content"]), "\n")
    return dossiers.withColumn("side_by_side", side_by_side(source, F.col("proposed_content")))


def reports(
    appeals: DataFrame,
    fragments: DataFrame,
    config: EngineConfig = DEFAULT,
    conflicts: DataFrame | None = None,
) -> DataFrame:
    """One wide report row per appeal.

    ``conflicts`` holds ``id, n_conflicts`` of proposals against the archive
    (see :mod:`tessella.operators.conflicts`).
    """
    full = with_diff(with_metrics(dossier(appeals, fragments), config.metrics))
    full = provenance_summary(full)
    pros, cons = governance_pros_cons(config.metrics)
    full = full.withColumn("pros", pros).withColumn("cons", cons)
    if conflicts is not None:
        full = full.join(conflicts.select("id", "n_conflicts"), "id", "left").na.fill(
            0, ["n_conflicts"]
        )
        full = full.withColumn(
            "cons",
            F.when(
                F.col("n_conflicts") > 0,
                F.array_append(
                    "cons",
                    F.concat(
                        F.lit("Conflict detected with "),
                        F.col("n_conflicts"),
                        F.lit(" existing fragment(s)"),
                    ),
                ),
            ).otherwise(F.col("cons")),
        )
    return full.withColumn(
        "report_explanation", explanation_text(F.col("ops"), F.size("cited"))
    ).withColumn("quality_distribution", quality_text(full))


def approve(
    appeals: DataFrame,
    requested: DataFrame,
    fragments: DataFrame,
    now: Column,
    approver: str = "user",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Promote requested pending appeals: (new fragments, new nodes, refused requests).

    New ids continue after the highest stored number in request order.
    """
    wanted = requested.select("id").distinct()
    pending = appeals.join(wanted, "id", "left_semi").where(
        F.col("status") == "pending_user_approval"
    )
    refused = wanted.join(pending.select("id"), "id", "left_anti")
    start = next_fragment_number(fragments).first()["next_id"]
    numbered = running_position(
        merged_metadata(dossier(pending, fragments)).withColumn("_one", F.lit(1)),
        ["_one"],
        ["seq", "id"],
        "n",
    )
    new_id = F.format_string("F-%04d", F.col("n") + F.lit(start - 1))
    with_source = F.filter("cited", lambda s: s["provenance"].isNotNull())
    origin = F.get(with_source, F.lit(0))["provenance"]
    promoted = (
        numbered.withColumn("new_id", new_id)
        .withColumn("_checksum", checksum(F.col("new_id"), F.col("proposed_content"), now))
        .withColumn("_origin", origin)
    )
    new_fragments = promoted.select(
        F.col("new_id").alias("id"),
        F.col("id").alias("appeal_id"),
        F.col("proposed_content").alias("content"),
        F.col("m_topic").alias("topic"),
        F.lit("governance:approve").alias("source"),
        F.col("m_quality").alias("quality"),
        F.col("m_author").alias("author"),
        F.col("m_tags").alias("tags"),
        F.col("sources").alias("parents"),
        F.lit("active").alias("status"),
        now.alias("created_at"),
        F.col("_checksum").alias("checksum"),
    )
    new_nodes = promoted.select(
        F.col("new_id").alias("fragment_id"),
        F.col("sources").alias("parents"),
        F.col("id").alias("appeal_id"),
        F.lit(approver).alias("approver"),
        F.col("_checksum").alias("checksum"),
        F.coalesce(F.col("_origin.final_source"), F.lit("")).alias("model_id"),
        F.lit("").alias("model_version"),
        F.lit(EMBEDDING_MODEL).alias("evaluator_model_id"),
        F.coalesce(F.col("_origin.final_source"), F.lit("governance_promotion")).alias(
            "quality_source"
        ),
        F.coalesce(F.to_json("_origin"), F.lit("")).alias("provenance_snapshot"),
    )
    return new_fragments, new_nodes, refused


def statistics(appeals: DataFrame, quarantine: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """One row of counts by status and the mean decision time."""
    seconds = (F.unix_micros("resolved_at") - F.unix_micros("created_at")) / 1_000_000
    counts = [
        F.count_if(F.col("status") == value).alias(name)
        for name, value in (
            ("approved", "approved"),
            ("rejected", "rejected"),
            ("pending", "pending_user_approval"),
            ("draft", "draft"),
            ("expired", "expired"),
        )
    ]
    mean = F.coalesce(F.avg(F.when(seconds >= 0, seconds)), F.lit(0.0))
    totals = appeals.agg(
        F.count(F.lit(1)).alias("total_appeals"), *counts, mean.alias("_mean")
    ).select(
        "total_appeals", "approved", "rejected", "pending", "draft", "expired",
        F.round("_mean", 2).alias("avg_seconds"),
        W.duration_text(F.col("_mean")).alias("avg_text"),
    )
    if quarantine is None:
        sizes = {"quarantine_size": 0, "unresolved": 0, "pending_notifications": 0}
        return totals.withColumns({k: F.lit(v).cast("long") for k, v in sizes.items()})
    from tessella.operators.quarantine import sizes as quarantine_sizes

    row = quarantine_sizes(quarantine, now).first()  # one aggregate row
    return totals.withColumns({k: F.lit(row[k]) for k in row.asDict()})


def best_parent(nodes: DataFrame, fragments: DataFrame) -> DataFrame:
    """``fragment_id, best_parent``: highest quality, first wins, else the last parent."""
    from tessella.scale import skew_join

    links = nodes.where(F.size("parents") > 0).select(
        "fragment_id",
        F.element_at("parents", -1).alias("_last"),
        F.posexplode("parents").alias("pos", "parent"),
    )
    quality = fragments.select(F.col("id").alias("parent"), "quality")
    rated = skew_join(links, quality, ["parent"], "left", ["fragment_id", "pos"])
    best = F.max_by(
        F.when(F.col("quality").isNotNull(), F.col("parent")),
        F.when(F.col("quality").isNotNull(), F.struct("quality", -F.col("pos"))),
    )
    return rated.groupBy("fragment_id").agg(
        F.coalesce(best, F.first("_last")).alias("best_parent")
    )


def rollback(fragments: DataFrame, nodes: DataFrame, ids: DataFrame):
    """(archive with the rows soft-deleted, ``id, previous`` per request).

    ``previous`` is NULL for rows without node, without parents or not stored.
    """
    asked = ids.select("id").distinct()
    stored = asked.join(fragments.select("id"), "id", "left_semi")
    parents = best_parent(
        nodes.join(stored.withColumnRenamed("id", "fragment_id"), "fragment_id", "left_semi"),
        fragments,
    ).withColumnRenamed("fragment_id", "id")
    known = fragments.select(F.col("id").alias("best_parent"))
    previous = parents.join(known, "best_parent", "left_semi")
    answer = asked.join(previous, "id", "left").select(
        "id", F.col("best_parent").alias("previous")
    )
    return soft_delete(fragments, parents), answer
