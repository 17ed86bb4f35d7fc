"""Fragment archive: keys, inserts, soft deletes, filters and bulk restore.

Tables are immutable; an operator returns the new table or the rows to append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessella.config import DEFAULT, EngineConfig
from tessella.functions import words as W
from tessella.scale import observed, skew_join, small_side


def iso_utc(ts: Column) -> Column:
    """ISO-8601 UTC text; microseconds appear only when they are not zero."""
    head = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        head,
        F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")),
        F.lit("+00:00"),
    )


def checksum(fragment_id: Column, content: Column, created_at: Column) -> Column:
    key = F.concat_ws("::", fragment_id, content, iso_utc(created_at))
    return F.substring(F.sha2(key, 256), 1, 16)


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def insert(incoming: DataFrame, archive: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Verdict per incoming row: ``accepted`` and, if refused, ``reject_reason``.

    Checks run in order: missing checksum, id already known, content too long.
    Among equal ids in the batch the earliest row that passes the other checks
    is the insert; later ones are duplicates.
    """
    # only the batch's own ids matter, so a small batch never shuffles the archive
    asked = small_side(incoming.select("id").distinct())
    known = archive.select("id").join(asked, "id", "left_semi").withColumn("_known", F.lit(True))
    limit = config.archive.max_content_length
    no_checksum = F.coalesce(F.col("checksum"), F.lit("")) == ""
    too_long = F.length("content") > limit
    # first candidate per id is a partial aggregate, so an id repeated in a
    # large share of the batch never gathers in one task
    first = (
        incoming.where(~no_checksum & ~too_long)
        .groupBy("id")
        .agg(F.min("seq").alias("_first"))
    )
    judged = skew_join(
        incoming, known.join(first, "id", "full"), ["id"], "left", spread_by=["seq"]
    )
    duplicate = F.coalesce(F.col("_known"), F.lit(False)) | (
        F.col("_first").isNotNull() & (F.col("seq") > F.col("_first"))
    )
    reason = (
        F.when(no_checksum, F.lit("missing_checksum"))
        .when(duplicate, F.lit("duplicate_id"))
        .when(too_long, F.lit("content_too_long"))
    )
    return (
        judged.withColumn("reject_reason", reason)
        .withColumn("accepted", F.col("reject_reason").isNull())
        .drop("_known", "_first")
    )


def soft_delete(fragments: DataFrame, ids: DataFrame) -> DataFrame:
    """Archive the named rows; they stay readable and searchable."""
    marks = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return (
        fragments.join(marks, "id", "left")
        .withColumn("status", F.when(F.col("_gone"), F.lit("archived")).otherwise(F.col("status")))
        .drop("_gone")
    )


def restore(rows: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Bulk restore: the last row of each key wins, nothing is validated."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, F.col(order)).alias("_row")).select("_row.*")


def list_fragments(
    fragments: DataFrame,
    topic: str | None = None,
    status: str | None = None,
    tags: list[str] | None = None,
) -> DataFrame:
    """Rows that meet every given condition; tags match any, ignoring case."""
    out = fragments
    if topic is not None:
        out = out.where(F.col("topic") == topic)
    if status is not None:
        out = out.where(F.col("status") == status)
    if tags is not None:
        wanted = W.strings([t.lower() for t in tags]).cast("array<string>")
        out = out.where(F.arrays_overlap(F.transform("tags", F.lower), wanted))
    return out


def search_by_keywords(fragments: DataFrame, keywords: list[str]) -> DataFrame:
    """Rows where a keyword is a condition keyword or occurs in the content."""
    hit = F.lit(False)
    listed = F.transform("conditions.keywords", F.lower)
    content = F.lower("content")
    for keyword in keywords:
        low = keyword.lower()
        hit = hit | F.array_contains(listed, low) | content.contains(low)
    return fragments.where(hit)


def search_by_quality(fragments: DataFrame, minimum: float) -> DataFrame:
    return fragments.where(F.col("quality") >= minimum)


def next_fragment_number(fragments: DataFrame) -> DataFrame:
    """One row: highest number behind an ``F-`` id plus one."""
    digits = F.regexp_extract("id", r"^F-(\d+)", 1)
    return fragments.agg(
        (F.coalesce(F.max(F.when(digits != "", digits.try_cast("bigint"))), F.lit(0)) + 1).alias(
            "next_id"
        )
    )


def latest_evaluation(provenance: Column) -> Column:
    return F.try_element_at(provenance["evaluations"], F.lit(-1))


def evaluations_from(provenance: Column, source: str) -> Column:
    return F.filter(provenance["evaluations"], lambda e: e["source"] == source)


def add_evaluation(provenance: Column, evaluation: Column) -> Column:
    """Append an evaluation; its score and source become the final ones."""
    return (
        provenance.withField(
            "evaluations", F.array_append(provenance["evaluations"], evaluation)
        )
        .withField("final_quality", evaluation["score"])
        .withField("final_source", evaluation["source"])
    )


def set_consensus(provenance: Column, score: Column, method: Column) -> Column:
    return (
        provenance.withField("consensus_score", score)
        .withField("consensus_method", method)
        .withField("final_quality", score)
        .withField("final_source", F.lit("majority_vote"))
    )


def shelf_statistics(fragments: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows per shelf with a grand total (shelf NULL)."""
    kept = fragments.groupBy("shelf").agg(F.count(F.lit(1)).alias("fragments"))
    lost = rejected.groupBy("shelf").agg(F.count(F.lit(1)).alias("rejected"))
    per_shelf = kept.join(lost, "shelf", "full").na.fill(0, ["fragments", "rejected"])
    return per_shelf.rollup("shelf").agg(
        F.sum("fragments").alias("fragments"), F.sum("rejected").alias("rejected")
    )


def counted(judged: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows that ``insert`` has judged, and an observation of what a write of them holds:
    judged, accepted, each refusal, and the characters accepted."""
    accepted, size = F.col("accepted"), F.length("content")
    return observed(
        judged,
        judged=F.count(F.lit(1)),
        accepted=F.count_if(accepted),
        refused=F.count_if(~accepted),
        characters=F.coalesce(F.sum(F.when(accepted, size)), F.lit(0)),
        longest=F.coalesce(F.max(F.when(accepted, size)), F.lit(0)),
    )
