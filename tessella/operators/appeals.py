"""Edit proposals: lifecycle, source resolution, metrics and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import schemas
from tessella.config import DEFAULT, AppealConfig, MetricConfig
from tessella.functions import words as W
from tessella.scale import skew_join

# -- lifecycle -------------------------------------------------------------------


def insert(incoming: DataFrame, existing: DataFrame, config: AppealConfig = DEFAULT.appeals) -> DataFrame:
    """Verdict per new draft: duplicate id, active limit, operation limit (in order).

    Only as many rows as there are free slots can succeed, so the running limit
    is the first ``free`` valid rows by ``seq`` instead of a global window.
    """
    free = max(0, config.max_active - active(existing).limit(config.max_active).count())
    known = existing.select("id", F.lit(True).alias("_known"))
    judged = skew_join(incoming, known, ["id"], "left", ["seq"]).withColumn(
        "_ops_ok", F.coalesce(F.size("ops"), F.lit(0)) <= config.max_ops
    )
    # an id repeated in the batch may fail on its first row (too many operations)
    # and succeed on a later one
    valid = (
        judged.where(F.col("_known").isNull() & F.col("_ops_ok"))
        .groupBy("id")
        .agg(F.min("seq").alias("_won"))
    )
    winners = valid.orderBy("_won").limit(free)
    taken = [r["_won"] for r in winners.collect()]  # at most max_active rows
    out = judged.join(F.broadcast(winners), "id", "left")
    if len(taken) < free:
        full = F.lit(False)
    else:
        full = F.col("seq") > (max(taken) if taken else -1)
    reason = (
        F.when(F.coalesce("_known", F.col("seq") > F.col("_won")), F.lit("duplicate_id"))
        .when(full, F.lit("too_many_active"))
        .when(~F.col("_ops_ok"), F.lit("too_many_ops"))
    )
    return (
        out.withColumn("reject_reason", reason)
        .withColumn("accepted", F.col("reject_reason").isNull())
        .drop("_known", "_ops_ok", "_won")
    )


def active(appeals: DataFrame) -> DataFrame:
    return appeals.where(~F.col("status").isin(*schemas.CLOSED_APPEAL_STATUSES))


def by_status(appeals: DataFrame, status: str | None = None) -> DataFrame:
    return appeals if status is None else appeals.where(F.col("status") == status)


def overlay(appeals: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Keyed updates: the newest change per id (by ``change_seq``) replaces values."""
    newest = changes.groupBy("id").agg(
        *[F.max_by(c, "change_seq").alias(f"_{c}") for c in columns]
    )
    out = appeals.join(newest, "id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c))).drop(f"_{c}")
    return out


def set_status(appeals: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Fold ``id, status, change_seq`` rows; only decisions stamp ``resolved_at``."""
    newest = changes.groupBy("id").agg(
        F.max_by("status", "change_seq").alias("_status"),
        F.max(F.col("status").isin(*schemas.DECIDED_APPEAL_STATUSES)).alias("_decided"),
    )
    return (
        appeals.join(newest, "id", "left")
        .withColumn("resolved_at", F.when(F.col("_decided"), now).otherwise(F.col("resolved_at")))
        .withColumn("status", F.coalesce("_status", "status"))
        .drop("_status", "_decided")
    )


def submit(appeals: DataFrame, ids: DataFrame) -> DataFrame:
    """Result per requested id: pending from any status; unknown ids are not found."""
    return ids.join(appeals.select("id", "status"), "id", "left").select(
        "id",
        F.col("status").isNotNull().alias("found"),
        F.when(F.col("status").isNotNull(), F.lit("pending_user_approval")).alias("status"),
    )


def reject(appeals: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Apply ``id, reason`` rejections; a reason replaces the explanation."""
    asked = requests.select("id", F.col("reason").alias("_reason"))
    hit = F.col("_reason").isNotNull()
    return (
        appeals.join(asked, "id", "left")
        .withColumn("status", F.when(hit, F.lit("rejected")).otherwise(F.col("status")))
        .withColumn("resolved_at", F.when(hit, now).otherwise(F.col("resolved_at")))
        .withColumn(
            "explanation",
            F.when(F.col("_reason") != "", F.col("_reason")).otherwise(F.col("explanation")),
        )
        .drop("_reason")
    )


def remove(appeals: DataFrame, ids: DataFrame) -> DataFrame:
    return appeals.join(ids.select("id"), "id", "left_anti")


def prune(
    appeals: DataFrame,
    now: Column,
    max_generations: int | None = None,
    retention_days: int | None = None,
    config: AppealConfig = DEFAULT.appeals,
) -> DataFrame:
    """Add ``pruned``: by age, or by count when no row was too old.

    Counting keeps the newest ``max_generations`` closed rows, which is a bounded
    top-n, not a global sort.
    """
    keep = max_generations or config.max_generations
    days = retention_days or config.retention_days
    closed = F.col("status").isin(*schemas.CLOSED_APPEAL_STATUSES)
    age_days = F.floor((F.unix_micros(now) - F.unix_micros("resolved_at")) / 86_400_000_000)
    flagged = appeals.withColumn(
        "_aged", F.coalesce(closed & (age_days > days), F.lit(False))
    )
    if not flagged.where("_aged").isEmpty():
        return flagged.withColumnRenamed("_aged", "pruned")
    newest = (
        appeals.where(closed)
        .orderBy(F.col("resolved_at").desc_nulls_last(), F.col("seq").desc())
        .limit(keep)
        .select("id", F.lit(True).alias("_kept"))
    )
    return (
        flagged.join(F.broadcast(newest), "id", "left")
        .withColumn("pruned", closed & F.col("_kept").isNull())
        .drop("_aged", "_kept")
    )


# -- sources ---------------------------------------------------------------------


def source_links(appeals: DataFrame) -> DataFrame:
    return appeals.select("id", F.posexplode("sources").alias("pos", "source_id"))


def resolve_sources(appeals: DataFrame, fragments: DataFrame) -> DataFrame:
    """Source rows per appeal in list order; unknown ids drop out, repeats stay.

    A fragment cited by a large share of all appeals is spread over many tasks.
    """
    one = fragments.withColumnRenamed("id", "source_id").withColumnRenamed("seq", "source_seq")
    return skew_join(source_links(appeals), one, ["source_id"], "inner", ["id", "pos"])


def missing_sources(appeals: DataFrame, fragments: DataFrame) -> DataFrame:
    one = fragments.select(F.col("id").alias("source_id"))
    return skew_join(source_links(appeals), one, ["source_id"], "left_anti", ["id", "pos"])


def appeals_citing(appeals: DataFrame, fragment_id: str) -> DataFrame:
    return appeals.where(F.array_contains("sources", fragment_id))


def dossier(appeals: DataFrame, fragments: DataFrame) -> DataFrame:
    """Appeals with ``cited``: the resolved sources as an ordered array.

    The array is as long as the appeal's own source list. Appeals without any
    surviving source keep an empty array.
    """
    slim = fragments.select(
        "id", "seq", "content", "quality", "topic", "tags", "author", "provenance"
    )
    row = F.struct(
        "pos", "source_id", "content", "quality", "topic", "tags", "author", "provenance"
    )
    lists = (
        resolve_sources(appeals, slim)
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(row), lambda a, b: a["pos"] - b["pos"]).alias("cited"))
    )
    empty = F.filter(
        F.array(F.lit(None).cast(lists.schema["cited"].dataType.elementType)),
        lambda r: r.isNotNull(),
    )
    return appeals.join(lists, "id", "left").withColumn("cited", F.coalesce("cited", empty))


# -- metrics and diff ------------------------------------------------------------


def best_cosine(appeals: DataFrame, proposal_vectors: DataFrame, source_vectors: DataFrame) -> DataFrame:
    """``id, best_cosine``: the largest cosine of a proposal to one of its cited sources.

    Each cited vector moves once to its citations, split where one source is cited by very
    many, and the maximum is taken by partial aggregates. Proposals without words, without
    sources of known vectors, or with a zero vector have 0.
    """
    blank = F.size(W.words(F.col("proposed_content"))) == 0
    cited = appeals.where(~blank).select("id", F.explode(F.array_distinct("sources")).alias("source"))
    sources = source_vectors.select(F.col("id").alias("source"), F.col("vec").alias("source_vec"))
    pairs = skew_join(cited, sources, ["source"], "inner", ["id"]).join(proposal_vectors.select("id", "vec"), "id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot("vec", "vec") * dot("source_vec", "source_vec"))
    cosine = F.when(size > 0, dot("vec", "source_vec") / size).otherwise(F.lit(0.0))
    best = pairs.groupBy("id").agg(F.max(cosine).alias("best_cosine"))
    return appeals.select("id").join(best, "id", "left").na.fill(0.0, ["best_cosine"])


def tanh_share(value: Column, scale: Column) -> Column:
    return F.when(scale <= 0, F.lit(0.0)).otherwise(F.tanh(value / scale))


def coverage(proposed: Column, sources: Column) -> Column:
    """Share of distinct source words that the proposal keeps."""
    return F.when(
        F.size(sources) == 0, F.when(F.size(proposed) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    ).otherwise(F.size(F.array_intersect(proposed, sources)) / F.size(sources))


def base_risk(
    proposed: Column, sources: Column, n_proposed: Column, n_sources: Column,
    config: MetricConfig = DEFAULT.metrics,
) -> Column:
    """Expansion, novelty and over-simplification, capped at 1."""
    ratio = n_proposed / F.greatest(n_sources, F.lit(1))
    limit = config.expansion_ratio
    expansion = F.when(
        ratio > limit, F.least((ratio - limit) / limit * 0.5, F.lit(0.5))
    ).otherwise(F.lit(0.0))
    novelty = F.when(
        (F.size(proposed) > 0) & (F.size(sources) > 0),
        F.size(F.array_except(proposed, sources)) / F.size(proposed) * 0.3,
    ).otherwise(F.lit(0.0))
    loss = F.when((ratio < 0.5) & (n_sources > 5), F.lit(0.2)).otherwise(F.lit(0.0))
    return F.when(
        n_sources == 0, F.when(n_proposed > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    ).otherwise(F.least(expansion + novelty + loss, F.lit(1.0)))


def with_metrics(
    dossiers: DataFrame,
    config: MetricConfig = DEFAULT.metrics,
    vector_coverage: str | None = None,
) -> DataFrame:
    """Add ``delta_token, coverage, risk, aggregate_score`` and the word sets.

    ``vector_coverage`` names a column with the best cosine of the proposal to a
    source; when given it blends into coverage and negations count as risk.
    """
    staged = (
        dossiers.withColumn("_pw", W.words(F.col("proposed_content")))
        .withColumn(
            "_sw", F.flatten(F.transform("cited", lambda s: W.words(s["content"])))
        )
        .withColumn("proposed_words", F.array_distinct("_pw"))
        .withColumn("source_words", F.array_distinct("_sw"))
        .withColumn("_np", F.size("_pw"))
        .withColumn("_ns", F.size("_sw"))
    )
    kept = coverage(F.col("proposed_words"), F.col("source_words"))
    risk = base_risk(
        F.col("proposed_words"), F.col("source_words"), F.col("_np"), F.col("_ns"), config
    )
    if vector_coverage:
        blend = config.embedding_blend
        kept = kept * (1 - blend) + F.col(vector_coverage) * blend
        negation = F.when(
            F.size("cited") > 0, W.negation_share(F.col("proposed_content"))
        ).otherwise(F.lit(0.0))
        risk = F.least(risk + negation * config.contradiction_penalty, F.lit(1.0))
    risk = F.least(
        risk + W.vagueness(F.col("proposed_content")) * config.vagueness_penalty, F.lit(1.0)
    )
    return (
        staged.withColumn("delta_token", F.col("_np") - F.col("_ns"))
        .withColumn("coverage", kept)
        .withColumn("risk", risk)
        .withColumn(
            "aggregate_score",
            tanh_share(F.col("delta_token"), F.greatest("_ns", F.lit(1))) * config.w_delta
            + F.col("coverage") * config.w_coverage
            - F.col("risk") * config.w_risk,
        )
        .drop("_pw", "_sw", "_np", "_ns")
    )


def reordered_positions(proposed: Column, cited: Column) -> Column:
    """Places where sources appear verbatim in another order than listed."""
    low = F.lower(proposed)
    ids = F.transform(cited, lambda s: s["source_id"])
    seen = F.filter(
        F.transform(
            cited,
            lambda s: F.struct(
                F.instr(low, F.lower(W.strip(s["content"]))).alias("at"),
                # a repeated source counts under its last place in the list
                (F.size(ids) - F.array_position(F.reverse(ids), s["source_id"])).cast("int").alias("place"),
                (W.strip(s["content"]) != "").alias("real"),
            ),
        ),
        lambda s: s["real"] & (s["at"] > 0),
    )
    order = F.transform(
        F.array_sort(
            F.transform(seen, lambda s, i: F.struct(s["at"].alias("at"), i.alias("i"), s["place"].alias("place")))
        ),
        lambda s: s["place"],
    )
    wrong = F.filter(
        F.transform(order, lambda p, i: F.when(p != i, i)), lambda i: i.isNotNull()
    )
    return F.when(F.size(order) < 2, F.array().cast("array<int>")).otherwise(wrong)


def with_diff(measured: DataFrame) -> DataFrame:
    """Add ``added, removed, modified, reordered``."""
    source_text = F.array_join(F.transform("cited", lambda s: s["content"]), " ")
    return (
        measured.withColumn(
            "added", F.array_sort(F.array_except("proposed_words", "source_words"))
        )
        .withColumn("removed", F.array_sort(F.array_except("source_words", "proposed_words")))
        .withColumn(
            "modified",
            W.line_changes(W.lines(F.col("proposed_content")), W.lines(source_text)),
        )
        .withColumn("reordered", reordered_positions(F.col("proposed_content"), F.col("cited")))
    )


def explanation_text(row_ops: Column, n_sources: Column) -> Column:
    """Sentence that explains measured metrics."""
    names = F.array_join(F.transform(row_ops, lambda o: o["op_type"]), ", ")
    delta = F.col("delta_token")
    change = (
        F.when(delta < 0, F.concat(F.lit("saves "), -delta, F.lit(" tokens")))
        .when(delta > 0, F.concat(F.lit("costs "), delta, F.lit(" additional tokens")))
        .otherwise(F.lit("does not change the token count"))
    )
    return F.concat(
        F.lit("This appeal proposes to "),
        F.when(names == "", F.lit("modify")).otherwise(names),
        F.lit(" content from "),
        n_sources.cast("string"),
        F.lit(" source fragment(s). It "),
        change,
        F.lit(", with "),
        W.percent(F.col("coverage")),
        F.lit("% content coverage and "),
        W.percent(F.col("risk")),
        F.lit("% estimated risk. The aggregate quality score is "),
        W.rounded(F.col("aggregate_score"), 3).cast("string"),
        F.lit("."),
    )


def _present(*options: Column) -> Column:
    return F.filter(F.array(*options), lambda o: o.isNotNull())


def governance_pros_cons(config: MetricConfig = DEFAULT.metrics) -> tuple[Column, Column]:
    """Pros and cons shown to an approver."""
    cov, risk, agg = F.col("coverage"), F.col("risk"), F.col("aggregate_score")
    delta = F.col("delta_token")
    pros = _present(
        F.when(cov >= 0.7, F.concat(F.lit("High coverage ("), W.percent(cov), F.lit("%) of source material"))),
        F.when(risk < config.low_risk, F.concat(F.lit("Low risk score ("), W.fixed(risk, 2), F.lit(")"))),
        F.when(delta > 0, F.concat(F.lit("Adds "), delta, F.lit(" new tokens of information")))
        .when(delta < 0, F.concat(F.lit("Reduces token count by "), -delta, F.lit(" tokens"))),
        F.when(agg >= 0.7, F.concat(F.lit("Strong aggregate score ("), W.fixed(agg, 2), F.lit(")"))),
        F.when(F.size("added") > 0, F.concat(F.lit("Adds "), F.size("added"), F.lit(" new passage(s)"))),
    )
    cons = _present(
        F.when(cov <= 0.3, F.concat(F.lit("Low coverage ("), W.percent(cov), F.lit("%) of source material"))),
        F.when(risk > 0.6, F.concat(F.lit("Elevated risk score ("), W.fixed(risk, 2), F.lit(")"))),
        F.when(agg <= 0.3, F.concat(F.lit("Low aggregate score ("), W.fixed(agg, 2), F.lit(")"))),
        F.when(
            F.size("removed") > 0,
            F.concat(F.lit("Removes "), F.size("removed"), F.lit(" existing passage(s)")),
        ),
    )
    return (
        F.when(F.size(pros) > 0, pros).otherwise(
            F.array(F.lit("No significant advantages identified"))
        ),
        F.when(F.size(cons) > 0, cons).otherwise(
            F.array(F.lit("No significant concerns identified"))
        ),
    )


def review_pros_cons(row_ops: Column) -> tuple[Column, Column]:
    """Second rule set, from the diff side."""
    cov, risk, agg = F.col("coverage"), F.col("risk"), F.col("aggregate_score")
    delta = F.col("delta_token")
    cov_text = F.concat(F.lit(" content coverage ("), W.percent(cov), F.lit("%)"))
    risk_text = F.concat(F.lit(" risk ("), W.percent(risk), F.lit("%)"))
    names = F.array_join(F.transform(row_ops, lambda o: o["op_type"]), ", ")
    pros = _present(
        F.when(delta < 0, F.concat(F.lit("Token savings: "), -delta, F.lit(" fewer tokens")))
        .when(delta == 0, F.lit("No change in token count")),
        F.when(cov >= 0.8, F.concat(F.lit("High"), cov_text)).when(
            cov >= 0.5, F.concat(F.lit("Moderate"), cov_text)
        ),
        F.when(risk < 0.2, F.concat(F.lit("Low"), risk_text)),
        F.when(agg > 0.5, F.lit("Strong aggregate quality score")),
        F.when(names != "", F.concat(F.lit("Operations proposed: "), names)),
    )
    cons = _present(
        F.when(delta > 0, F.concat(F.lit("Token increase: "), delta, F.lit(" additional tokens"))),
        F.when(cov < 0.5, F.concat(F.lit("Low"), cov_text)),
        F.when((risk >= 0.2) & (risk < 0.5), F.concat(F.lit("Moderate"), risk_text)).when(
            risk >= 0.5, F.concat(F.lit("High"), risk_text)
        ),
        F.when(agg < 0, F.lit("Negative aggregate quality score")),
    )
    return pros, cons


def running_active(appeals: DataFrame) -> DataFrame:
    """Count of active rows per status, one pass."""
    return active(appeals).groupBy("status").agg(F.count(F.lit(1)).alias("n"))

