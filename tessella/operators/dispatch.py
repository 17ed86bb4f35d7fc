"""Routing of queries: compose, compose partially, or generate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import DEFAULT, DispatchConfig
from tessella.functions import words as W
from tessella.operators.intake import scan


def plan(scanned: DataFrame, config: DispatchConfig = DEFAULT.dispatch) -> DataFrame:
    """Route every scanned query. Costs are reported; only coverage decides."""
    aspects, matched = F.size("aspects"), F.size("matched")
    ratio = matched / F.greatest(aspects, F.lit(1))
    query_words = W.word_count(F.col("text"))
    stored_words = F.aggregate(
        F.transform("certified", lambda c: W.word_count(c["content"])),
        F.lit(0),
        lambda acc, n: acc + n,
    )
    aspect_words = F.aggregate(
        F.transform("aspects", W.word_count), F.lit(0), lambda acc, n: acc + n
    )
    ready = F.col("should_proceed") & (F.size("certified") > 0)
    route = (
        F.when(ready & (F.col("ratio") >= config.compose_at), F.lit("compose"))
        .when(ready & (F.col("ratio") >= config.partial_at), F.lit("partial"))
        .otherwise(F.lit("generate"))
    )
    routed = (
        scanned.withColumn("ratio", ratio)
        .withColumn("path", route)
        .withColumn(
            "compose_cost", (query_words + stored_words * F.lit(1.1)) * F.lit(config.cost_factor)
        )
        .withColumn(
            "generate_cost",
            (query_words + aspect_words)
            * F.lit(3.0)
            * F.lit(config.cost_factor)
            * F.lit(config.generate_penalty),
        )
        .withColumn("_ready", ready)
    )
    generate = F.col("path") == "generate"
    share = F.concat(W.percent(F.col("ratio")), F.lit("%"))
    covered = F.concat(matched.cast("string"), F.lit("/"), aspects.cast("string"))
    costs = F.concat(
        F.lit("ompose cost ("),
        W.fixed(F.col("compose_cost"), 1),
        F.lit(") < generate cost ("),
        W.fixed(F.col("generate_cost"), 1),
        F.lit(")"),
    )
    listed = F.concat(F.lit("['"), F.array_join("missing", "', '"), F.lit("']"))
    reason = (
        F.when(
            F.col("path") == "compose",
            F.concat(
                F.lit("Full composition: "), covered, F.lit(" aspects covered ("), share,
                F.lit("), c"), costs,
            ),
        )
        .when(
            F.col("path") == "partial",
            F.concat(
                F.lit("Partial composition: "), covered, F.lit(" aspects covered ("), share,
                F.lit("). Missing: "), listed, F.lit(". C"), costs,
            ),
        )
        .when(
            ~F.col("_ready"),
            F.lit("Full generation: No certified candidates found by Intake Verifier"),
        )
        .otherwise(
            F.concat(
                F.lit("Full generation: Coverage too low ("),
                W.fixed(F.col("ratio") * 100, 1),
                F.lit(f"% < {config.partial_at:.0%})"),
            )
        )
    )
    nothing = F.array().cast("array<string>")
    return (
        routed.withColumn("reason", reason)
        .withColumn("covered", F.when(generate, nothing).otherwise(F.col("matched")))
        .withColumn(
            "missing",
            F.when(generate, F.col("aspects"))
            .when(F.col("path") == "compose", nothing)
            .otherwise(F.col("missing")),
        )
        .withColumn(
            "gap_description",
            F.when(F.col("path") == "partial", W.gap_sentence(F.col("missing"))).otherwise(F.lit("")),
        )
        .withColumn("coverage", F.when(generate, F.lit(0.0)).otherwise(F.col("ratio")))
        .withColumn("compose_cost", F.when(generate, F.lit(0.0)).otherwise(F.col("compose_cost")))
        .withColumn("generate_cost", F.when(generate, F.lit(0.0)).otherwise(F.col("generate_cost")))
        .drop("_ready", "ratio")
    )


def dispatch(
    fragments: DataFrame, queries: DataFrame, config: DispatchConfig = DEFAULT.dispatch, **scan_args
) -> DataFrame:
    return plan(scan(fragments, queries, config.scan_depth, **scan_args), config)
