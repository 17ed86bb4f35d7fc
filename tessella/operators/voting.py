"""Scorers, routing and majority votes; calibration against labelled rows.

The scorers of a circuit are a short configured list, so their scores live in
one map per row and no shuffle is needed to reach a verdict.
"""

from __future__ import annotations

import random
import zlib
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import schemas
from tessella.config import DEFAULT, CircuitConfig
from tessella.functions import lexicon as lx
from tessella.functions import words as W
from tessella.operators.archive import clamp01, set_consensus
from tessella.scale import filter_once, top_per_group

# content, quality and the shared base score → score
Scorer = Callable[[Column, Column, Column], Column]


def base_score(content: Column, quality: Column) -> Column:
    """Length and junk-marker heuristic of the built-in scorer, before noise."""
    by_length = W.bind(
        W.word_count(content),
        lambda n: F.when(n < 5, F.greatest(F.lit(0.0), quality - 0.3))
        .when(n < 15, quality)
        .otherwise(F.least(F.lit(1.0), quality + 0.1)),
    )
    junk = W.bind(
        F.lower(content),
        lambda low: F.exists(W.strings(lx.JUNK_MARKERS), lambda marker: low.contains(marker)),
    )
    return F.when(junk, F.greatest(F.lit(0.0), by_length - 0.4)).otherwise(by_length)


def scorer_noise(name: str) -> Callable[[Column], Column]:
    """Reproducible noise in ±0.05, seeded by the content and the scorer name."""

    @F.pandas_udf("double")
    def noise(content: pd.Series) -> pd.Series:
        return content.map(
            lambda c: (random.Random(zlib.crc32(f"{c}::{name}".encode())).random() - 0.5) * 0.1
        )

    return noise


def mock_scorer(name: str, noisy: bool = True) -> Scorer:
    bias = lx.AGENT_BIASES.get(name, 0.0)

    def score(content: Column, quality: Column, base: Column) -> Column:
        if noisy:
            base = F.round(clamp01(base + scorer_noise(name)(content)), 4)
        return F.round(clamp01(base + F.lit(bias)), 4)

    return score


def mock_scorers(names: list[str] | None = None, noisy: bool = True) -> dict[str, Scorer]:
    return {n: mock_scorer(n, noisy) for n in (names or list(lx.AGENT_BIASES))}


def with_scores(rows: DataFrame, scorers: dict[str, Scorer]) -> DataFrame:
    """Add ``scores``: scorer name → score; NULL means the scorer did not answer.

    Every scorer is a column function, so external ones plug in as pandas UDFs.
    """
    inputs = F.col("content"), F.col("quality"), F.col("_base")
    based = rows.withColumn("_base", base_score(F.col("content"), F.col("quality")))
    raw = based.withColumns({f"_score_{n}": s(*inputs) for n, s in scorers.items()})
    entries = []
    for name in scorers:
        given = F.col(f"`_score_{name}`")
        entries += [F.lit(name), F.when(given.isNotNull(), clamp01(given))]
    return raw.withColumn("scores", F.create_map(*entries)).drop(
        "_base", *[f"_score_{n}" for n in scorers]
    )


def route(quality: Column, source: Column, config: CircuitConfig = DEFAULT.circuit) -> Column:
    """vote, reject or accept before any scorer runs."""
    return (
        F.when(source == "user_claimed", F.lit("vote"))
        .when(quality < config.hard_reject, F.lit("reject"))
        .when(quality > config.grey_high, F.lit("accept"))
        .otherwise(F.lit("vote"))
    )


def verdict(scored: DataFrame, config: CircuitConfig = DEFAULT.circuit) -> DataFrame:
    """Vote counts and outcome per row; needs ``scores`` and ``route``.

    ``enough`` is false where fewer scorers than required answered; such rows
    belong in quarantine.
    """
    answered = F.filter(F.map_values("scores"), lambda s: s.isNotNull())
    voted = F.col("route") == "vote"
    n = F.size("_answers")
    yes = F.size(F.filter("_answers", lambda s: s >= config.vote_at))
    total = F.aggregate("_answers", F.lit(0.0), lambda acc, s: acc + s)
    took = F.col("route") == "accept"
    quality = F.col("quality")
    return (
        scored.withColumn("_answers", answered)
        .withColumn("votes_for", F.when(voted, yes).otherwise(took.cast("int")))
        .withColumn("votes_against", F.when(voted, n - yes).otherwise((~took).cast("int")))
        .withColumn("responded", F.when(voted, n).otherwise(F.lit(0)))
        .withColumn("enough", ~voted | (n >= config.min_agents))
        .withColumn(
            "mean_score",
            F.when(voted & (n > 0), F.round(total / n, 4)).when(voted, F.lit(0.0)).otherwise(quality),
        )
        .withColumn(
            "min_score",
            F.when(voted, F.round(F.coalesce(F.array_min("_answers"), F.lit(0.0)), 4)).otherwise(quality),
        )
        .withColumn(
            "max_score",
            F.when(voted, F.round(F.coalesce(F.array_max("_answers"), F.lit(0.0)), 4)).otherwise(quality),
        )
        .withColumn("accepted", F.col("votes_for") > F.col("votes_against"))
        .withColumn(
            "consensus",
            ~voted
            | (F.col("votes_for") == 0)
            | (F.col("votes_against") == 0)
            | (F.col("votes_for") >= 2),
        )
        .drop("_answers")
    )


def evaluate(
    fragments: DataFrame,
    scorers: dict[str, Scorer] | None = None,
    config: CircuitConfig = DEFAULT.circuit,
) -> DataFrame:
    """Route every row and let the scorers vote where the route says so."""
    routed = fragments.withColumn(
        "route", route(F.col("quality"), F.col("provenance.final_source"), config)
    )
    asked = scorers or mock_scorers()
    votes = F.col("route") == "vote"
    unasked = F.create_map(*[x for n in asked for x in (F.lit(n), F.lit(None).cast("double"))])
    # scorers may cost money: only the rows that vote reach them
    scored = with_scores(routed.where(votes), asked).unionByName(
        routed.where(~votes).withColumn("scores", unasked)
    )
    return verdict(scored, config)


def accepted_fragments(
    voted: DataFrame, at: Column, config: CircuitConfig = DEFAULT.circuit
) -> DataFrame:
    """Accepted rows with provenance; voted ones get a new id and the mean score."""
    kept = filter_once(voted, F.col("accepted") & F.col("enough"))
    by_vote = F.col("route") == "vote"
    source = F.when(
        F.col("quality") > config.grey_high, F.lit("independently_verified")
    ).otherwise(F.lit("evaluator_computed"))

    def evaluation(score, origin, model, version, meta):
        return F.struct(
            at.alias("timestamp"),
            model.alias("model_id"),
            F.lit(version).alias("model_version"),
            score.alias("score"),
            origin.alias("source"),
            meta.alias("metadata"),
        ).cast(schemas.EVALUATION)

    ballots = F.transform(
        F.filter(F.map_entries("scores"), lambda e: e["value"].isNotNull()),
        lambda e: evaluation(
            e["value"], F.lit("llm_self_reported"), e["key"], "",
            F.create_map(F.lit("agent"), e["key"]),
        ),
    )
    single = F.array(
        evaluation(
            F.col("quality"), source, F.lit("pre_filter"), "1.0",
            F.create_map(F.lit("threshold"), F.lit(str(config.grey_high))),
        )
    )
    blank = F.struct(
        F.when(by_vote, ballots).otherwise(single).alias("evaluations"),
        F.col("quality").alias("final_quality"),
        source.alias("final_source"),
        F.lit(None).cast("double").alias("consensus_score"),
        F.lit(None).cast("string").alias("consensus_method"),
    )
    agreed = set_consensus(blank, F.col("mean_score"), F.lit(config.consensus_method))
    return (
        kept.withColumn("provenance", F.when(by_vote, agreed).otherwise(blank))
        .withColumn("id", F.when(by_vote, F.concat("id", F.lit("_vetted"))).otherwise(F.col("id")))
        .withColumn("quality", F.when(by_vote, F.col("mean_score")).otherwise(F.col("quality")))
    )


# -- calibration -----------------------------------------------------------------


def agreement_rate(yes: Column, n: Column) -> Column:
    """Share of agreeing scorer pairs (1 with fewer than two scorers)."""
    no = n - yes
    return F.when(n < 2, F.lit(1.0)).otherwise(
        (yes * (yes - 1) + no * (no - 1)) / (n * (n - 1))
    )


def judge_examples(
    examples: DataFrame, scorers: dict[str, Scorer] | None = None, threshold: float = 0.8
) -> DataFrame:
    """Per labelled row: majority decision, correctness, agreement and error."""
    scored = with_scores(
        examples.withColumn("quality", F.col("claimed_quality")), scorers or mock_scorers()
    )
    values = F.map_values("scores")
    n = F.size("scores")
    should = F.when(F.col("ground_truth") == "good", F.lit(True)).when(
        F.col("ground_truth").isin("bad", "junk"), F.lit(False)
    )
    return (
        scored.withColumn("accepts", F.size(F.filter(values, lambda s: s >= threshold)))
        .withColumn("majority", F.col("accepts") > n / 2)
        .withColumn("correct", F.when(should.isNotNull(), F.col("majority") == should))
        .withColumn("agreement", agreement_rate(F.col("accepts"), n))
        .withColumn("mean_score", F.aggregate(values, F.lit(0.0), lambda a, s: a + s) / n)
        .withColumn("score_error", F.abs(F.col("mean_score") - F.col("true_quality")))
        .withColumn("should_accept", should)
    )


def calibration_summary(judged: DataFrame) -> DataFrame:
    """One row of totals; borderline rows count in ``total`` only."""
    right = F.count_if(F.col("correct"))
    return judged.agg(
        F.count(F.lit(1)).alias("total"),
        right.alias("correct"),
        F.count_if(~F.col("correct") & F.col("majority")).alias("false_positives"),
        F.count_if(~F.col("correct") & ~F.col("majority")).alias("false_negatives"),
        F.coalesce(F.avg("agreement"), F.lit(0.0)).alias("mean_agreement"),
        F.coalesce(F.avg("score_error"), F.lit(0.0)).alias("mean_score_error"),
        F.coalesce(F.try_divide(right, F.count(F.lit(1))), F.lit(0.0)).alias("accuracy"),
    )


def scorer_summary(judged: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per scorer: accuracy credited by majority, own accuracy, and generosity."""
    own = (F.col("score") >= threshold) == F.col("should_accept")
    return (
        judged.select(
            "correct", "true_quality", "should_accept", F.explode("scores").alias("agent", "score")
        )
        .groupBy("agent")
        .agg(
            (F.count_if(F.col("correct")) / F.count(F.lit(1))).alias("accuracy"),
            (F.count_if(own) / F.count(F.lit(1))).alias("own_accuracy"),
            (F.avg("score") - F.avg("true_quality")).alias("generosity"),
        )
    )


def counts_by_label(examples: DataFrame) -> DataFrame:
    """Rows per label, zero for labels that do not occur."""
    spark = examples.sparkSession
    labels = spark.createDataFrame(
        [(label,) for label in schemas.CALIBRATION_LABELS], "ground_truth string"
    )
    counted = examples.groupBy("ground_truth").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(counted, "ground_truth", "left").na.fill(0, ["n"])


def stratified_sample(examples: DataFrame, n_per_label: int = 5, seed: int = 42) -> DataFrame:
    """``n_per_label`` rows per label in a reproducible pseudo-random order."""
    keyed = examples.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(str(seed)), "id")))
    return top_per_group(
        keyed, ["ground_truth"], [F.col("_draw").asc(), F.col("id").asc()], n_per_label
    ).drop("_draw")
