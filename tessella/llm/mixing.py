"""Mixing documents to target weights with soft membership.

A naive Bayes classifier over hashed words, counted on the labelled rows, gives each
document a posterior over the domains. Document rates, never negative, are then fitted so
that the expected tokens of each domain (rate x tokens x posterior) match its target:
projected gradient on least squares. Posteriors are not rounded and each document has its
own rate; each gradient step is one aggregation over a narrow table of all documents.
Column functions and aggregates only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import quoted
from tessella.scale import cut, small_side

WHITE = r"[\x20\x09-\x0D]+"
TERMS = 8192
# Unit of the columns _q*: they sum to GRID, and need not be whole numbers.
GRID = 32
# Weighted steps; then plain ones, which always converge, up to LIMIT steps in all.
STEPS = 60
LIMIT = 1000
TOLERANCE = 1e-9
# Mean move of the rates, by tokens, in a plain step at which the fit has settled.
SETTLED = 1e-7
# Shares of all tokens that each domain of the labels should end up with.
TARGETS = {"plain": 0.80, "low": 0.15, "toxic": 0.05}


def domain_of_labels() -> Column:
    """Domain of a row of labels: toxic before low quality before plain; NULL if unmarked."""
    return (
        F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "plain")
    )


def words_of(text: Column) -> Column:
    """Words of a text; a NULL or blank one has none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def term_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(TERMS)).cast("int")


def fit_domains(labelled: DataFrame, domains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(log prior of each domain, log-probability of each term and domain) from (text,
    domain). The counts are one aggregation over all labelled words; TERMS x domains
    numbers reach the driver."""
    sizes = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros((len(domains), TERMS))
    listed = labelled.select("domain", F.explode(words_of(F.col("text"))).alias("word"))
    for row in listed.groupBy("domain", term_of(F.col("word")).alias("term")).agg(F.count("*").alias("n")).collect():
        counts[domains.index(row["domain"]), row["term"]] = row["n"]
    prior = np.array([sizes.get(d, 0) for d in domains], float)
    prior = np.log(np.maximum(prior, 1e-9) / max(prior.sum(), 1e-9))
    return prior, np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * TERMS))


def cells(words: Column, prior: np.ndarray, terms: np.ndarray) -> list[Column]:
    """Log-odds of each domain but the first against the first.

    The evidence of n words counts as sqrt(n) of them, which keeps memberships soft.
    """
    odds = terms[1:] - terms[0]
    tables = [F.lit(row.tolist()) for row in odds]
    names = [f"e{i}" for i in range(len(odds))]
    start = F.struct(*[F.lit(0.0).alias(n) for n in names])
    total = F.aggregate(
        F.transform(words, term_of),
        start,
        lambda s, t: F.struct(*[(s[n] + F.get(table, t)).alias(n) for n, table in zip(names, tables, strict=True)]),
    )
    soft = F.sqrt(F.greatest(F.size(words), F.lit(1)))
    return [(F.lit(float(p - prior[0])) + total[n] / soft) for n, p in zip(names, prior[1:], strict=True)]


def memberships(df: DataFrame, text: str, prior: np.ndarray, terms: np.ndarray) -> DataFrame:
    """``df`` with _tokens and the posteriors _q0, _q1, ..., which sum to GRID."""
    k = len(prior)
    with_words = df.withColumn("_words", words_of(F.col(text)))
    if k == 1:
        return with_words.withColumn("_tokens", F.size("_words").cast("long")).withColumn(
            "_q0", F.lit(float(GRID))
        ).drop("_words", text)
    odds = with_words.withColumn("_odds", F.array(*cells(F.col("_words"), prior, terms)))
    weight = [F.lit(1.0)] + [
        F.exp(F.greatest(F.least(F.get("_odds", F.lit(i)), F.lit(40.0)), F.lit(-40.0))) for i in range(k - 1)
    ]
    weighted = odds.withColumn("_weights", F.array(*weight)).withColumn("_tokens", F.size("_words").cast("long"))
    weighted = weighted.drop("_words", "_odds", text)
    total = reduce(lambda a, b: a + b, [F.get("_weights", F.lit(i)) for i in range(k)])
    return weighted.select(
        *[quoted(c) for c in weighted.columns if c != "_weights"],
        *[(F.lit(float(GRID)) * F.get("_weights", F.lit(i)) / total).alias(f"_q{i}") for i in range(k)],
    )


def fit_rates(rows: DataFrame, targets: np.ndarray) -> DataFrame:
    """``rows`` (_q0.., _tokens) with their rate.

    Projected gradient on the residual of the expected domain tokens. The residual is
    weighted by the inverse of the domains' overlap among the rows with a rate above zero,
    so that a step of length one meets the targets unless further rates reach zero. The fit
    ends when the targets are met or, out of reach, when a plain step moves no rate; a fit
    that does neither within LIMIT steps is an error.
    """
    k = len(targets)
    share = [F.col(f"_q{i}") / F.lit(float(GRID)) for i in range(k)]
    total = float(rows.agg(F.sum("_tokens")).first()[0] or 0)
    if total <= 0:
        return rows.withColumn("rate", F.lit(1.0))
    state = rows.withColumn("_x", F.lit(1.0))
    pending: list[np.ndarray] = []
    for n in range(LIMIT):
        above = F.when(F.col("_now") > 0, F.col("_tokens")).otherwise(0)
        got = (
            state.withColumn("_now", moved(pending, k))
            .agg(
                *[F.sum(F.col("_now") * F.col("_tokens") * share[i]).alias(f"t{i}") for i in range(k)],
                *[F.sum(above * share[i] * share[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)],
            )
            .first()
        )
        residual = np.array([got[f"t{i}"] for i in range(k)], float) / total - targets
        if np.abs(residual).max() < TOLERANCE:
            break
        overlap = np.array([[got[f"g{i}_{j}"] for j in range(k)] for i in range(k)], float) / total
        step = np.linalg.pinv(overlap, rcond=1e-9) @ residual if n < STEPS else residual
        if np.abs(step).max() < TOLERANCE or n >= STEPS and n % 12 == 0:
            now = state.withColumn("_now", moved(pending, k))
            gap = F.abs(F.col("_now") - moved([residual], k, "_now")) * F.col("_tokens")
            if now.agg(F.sum(gap)).first()[0] / total < SETTLED:
                break
            step = residual
        pending.append(step)
        if len(pending) == 12:  # keeps expressions short
            state = cut(state.withColumn("_x", moved(pending, k)))
            pending = []
    else:
        raise RuntimeError(f"rates have not settled in {LIMIT} steps; residual {residual.tolist()}")
    return state.withColumn("rate", moved(pending, k)).drop("_x")


def moved(steps: list[np.ndarray], k: int, start: str = "_x") -> Column:
    """``start`` after the given gradient steps, each projected on numbers >= 0."""
    x = F.col(start)
    for step in steps:
        move = [F.col(f"_q{i}") / F.lit(float(GRID)) * F.lit(float(step[i])) for i in range(k)]
        x = F.greatest(x - reduce(lambda a, b: a + b, move), F.lit(0.0))
    return x


def mix_documents(
    documents: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    domain: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: tuple[str, ...] = (),
    label_id_column: str = "doc_id",
) -> DataFrame:
    """One row per document: id, the columns of ``keep`` (named unlike the following),
    n_tokens (words), p_<domain> for each target domain (summing to 1), rate
    (>= 0).

    ``domain`` maps a row of labels to a domain; rows that map to none of the targets, and
    documents without text, teach nothing. Of several labels of one id the alphabetically
    last domain counts. A domain that no label shows has posterior 0 and its target is
    shared out to the others; without any label all rates are 1 and posteriors 0. A NULL
    or empty text has no tokens and the prior as posterior. Repeated rows and NULL ids stay
    rows of their own; an empty table gives an empty result. No rows are dropped.
    """
    targets = TARGETS if targets is None else targets
    marks = labels.select(quoted(label_id_column).alias("_id"), (domain_of_labels() if domain is None else domain).alias("domain"))
    marks = marks.where(F.col("domain").isin(*targets) & F.col("_id").isNotNull())
    marks = marks.groupBy("_id").agg(F.max("domain").alias("domain"))
    texts = documents.where(quoted(text_column).isNotNull()).select(
        quoted(id_column).alias("_id"), quoted(text_column).alias("text")
    )
    labelled = texts.join(small_side(cut(marks)), "_id")
    present = sorted(r["domain"] for r in labelled.select("domain").distinct().collect())
    kept = [id_column, *[c for c in keep if c != id_column]]
    rows = documents.select(
        *[quoted(c).alias(f"k{i}") for i, c in enumerate(kept)], quoted(text_column).alias("_text")
    )
    names = [f"k{i}" for i in range(len(kept))]
    if present:
        scored = cut(memberships(rows, "_text", *fit_domains(labelled, present)))
        wanted = np.array([targets[d] for d in present], float)
        scored = fit_rates(scored, wanted / wanted.sum())
    else:
        scored = rows.select(*names, F.size(words_of(F.col("_text"))).cast("long").alias("_tokens"), F.lit(1.0).alias("rate"))
    share = {d: F.col(f"_q{i}") / F.lit(float(GRID)) for i, d in enumerate(present)}
    return scored.select(
        *[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)],
        F.col("_tokens").alias("n_tokens"),
        *[share.get(d, F.lit(0.0)).alias(f"p_{d}") for d in sorted(targets)],
        "rate",
    )


def copies(rate_column: str, id_column: str, seed: int = 0) -> Column:
    """Whole number of copies of a document: its rate, rounded up or down by a draw that
    depends on the id, so that expected copies equal the rate."""
    bits = F.xxhash64(F.lit(seed), quoted(id_column).cast("string")).bitwiseAND(2**52 - 1)
    return F.floor(quoted(rate_column) + bits / F.lit(2.0**52)).cast("int")
