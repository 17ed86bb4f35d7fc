"""Quality gate: source-aware thresholds and one improvement attempt."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import schemas
from tessella.config import DEFAULT, GateConfig
from tessella.functions import lexicon as lx


def threshold_for(source: Column, config: GateConfig = DEFAULT.gate) -> Column:
    """Threshold of a quality source; unknown or missing sources use the default."""
    expr = F.when(F.lit(False), F.lit(config.default_threshold))
    for name, value in config.source_thresholds.items():
        expr = expr.when(source == name, F.lit(value))
    return expr.otherwise(F.lit(config.default_threshold))


def is_certified(
    quality: Column, source: Column, config: GateConfig = DEFAULT.gate
) -> Column:
    return quality >= threshold_for(source, config)


def parse_overrides(raw: Column) -> Column:
    """Keep overrides of known sources; NULL when none is left."""
    known = F.map_filter(raw, lambda k, v: k.isin(list(schemas.QUALITY_SOURCES)))
    return F.when(F.size(known) > 0, known)


def heuristic_improve(fragments: DataFrame, config: GateConfig = DEFAULT.gate) -> DataFrame:
    """Rule-based improvement; provenance, author, date and status start afresh.

    ``improved`` is NULL where the boosted quality stays below the floor.
    """
    quality = F.least(F.col("quality") + config.boost, F.lit(config.boost_cap))
    new = F.struct(
        F.concat("id", F.lit("_improved")).alias("id"),
        F.concat("content", F.lit(lx.IMPROVED_SUFFIX)).alias("content"),
        quality.alias("quality"),
        F.array_union("tags", F.array(F.lit("enhanced"), F.lit("auto_improved"))).alias("tags"),
        F.array("id").alias("parents"),
    )
    return fragments.withColumn("improved", F.when(quality >= config.improver_floor, new))


def guard(
    fragments: DataFrame,
    config: GateConfig = DEFAULT.gate,
    improve: Callable[[DataFrame], DataFrame] | None = heuristic_improve,
    floor: Column | None = None,
) -> DataFrame:
    """Add ``decision``: accept, accept_improved or reject.

    A row below its threshold is improved once and tested again; the improved
    row carries no quality source, so the default threshold applies to it. Pass
    ``improve`` to plug in another improver that adds an ``improved`` struct.
    ``floor`` is the threshold of the row's shelf (NULL: none): rows without a known
    source, and improved ones, are measured by it instead of the default.
    """
    source = F.col("provenance.final_source")
    default = F.lit(config.default_threshold)
    if floor is not None:
        default = F.coalesce(floor, default)
    known = F.coalesce(source.isin(list(config.source_thresholds)), F.lit(False))
    judged = fragments.withColumn(
        "threshold", F.when(known, threshold_for(source, config)).otherwise(default)
    )
    if improve is None:
        judged = judged.withColumn("improved", F.lit(None))
        second = F.lit(False)
    else:
        judged = improve(judged)
        second = F.coalesce(
            F.col("improved.quality") >= default, F.lit(False)
        )
    decision = (
        F.when(F.col("quality") >= F.col("threshold"), F.lit("accept"))
        .when(second, F.lit("accept_improved"))
        .otherwise(F.lit("reject"))
    )
    return judged.withColumn("decision", decision)


def admitted(guarded: DataFrame) -> DataFrame:
    """Rows that pass the gate, improved ones in their new form."""
    better = F.col("decision") == "accept_improved"
    changed = ("id", "content", "quality", "tags", "parents")
    out = guarded.where(F.col("decision") != "reject")
    for name in changed:
        out = out.withColumn(
            f"_{name}", F.when(better, F.col(f"improved.{name}")).otherwise(F.col(name))
        )
    out = out.withColumn("provenance", F.when(~better, F.col("provenance")))
    out = out.withColumn("author", F.when(better, F.lit("")).otherwise(F.col("author")))
    return out.drop(*changed, "improved", "threshold", "decision").withColumnsRenamed(
        {f"_{name}": name for name in changed}
    )


def rejections(guarded: DataFrame) -> DataFrame:
    """Side output of the gate."""
    return guarded.where(F.col("decision") == "reject").select(
        "id", "shelf", "quality", "topic", F.lit("quality below threshold").alias("reason")
    )


def add_to_shelf(fragments: DataFrame, shelf_topic: str, config: GateConfig = DEFAULT.gate):
    """Gated insert: (rows to add, rejection log)."""
    topic = F.coalesce(F.nullif("topic", F.lit("")), F.lit(shelf_topic))
    guarded = guard(fragments.withColumn("topic", topic), config)
    return admitted(guarded), rejections(guarded)


def parse_score_reply(reply: Column, whole_text: bool = False) -> Column:
    """Score out of a free-form scorer reply.

    Code fences are stripped; JSON ``score`` is used when the reply parses, else
    the first number on a line that mentions a score (or in the whole text),
    else 0.5. Returns a struct of ``score`` and ``parse_failed``.
    """
    body = F.trim(reply)
    inner = F.regexp_extract(body, r"(?s)```\s*(?:json)?\s*(\{.*?)\s*```", 1)
    body = F.when(inner != "", inner).otherwise(body)
    parsed = F.try_parse_json(body)
    is_object = parsed.isNotNull() & F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    from_json = F.when(
        is_object,
        F.coalesce(F.try_variant_get(parsed, "$.score", "double"), F.lit(0.5)),
    )
    scope = body if whole_text else F.regexp_extract(body, r"(?im)^(.*score.*)$", 1)
    number = F.regexp_extract(scope, r"(0\.\d+|1\.0)", 1).try_cast("double")
    score = F.coalesce(from_json, number, F.lit(0.5))
    return F.struct(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"),
        (~is_object | parsed.isNull()).alias("parse_failed"),
    )
