"""Quality rules: plain counts per text, and robust multivariate outliers per group.

Counts are array functions over the words and lines of one row. Their transformed vectors
are judged per language and source by minimum-covariance-determinant estimates: from
medians, concentration steps keep the H_SHARE of rows nearest to the current centre and
take mean and covariance of these; rows far from the last estimate are rejected. All
steps are aggregations with partial results per task, so a group of any size is spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import quoted
from tessella.scale import cut, small_side

WHITE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

H_SHARE = 0.75
STEPS = 5
# Groups with fewer judged rows share one estimate.
MIN_GROUP = 50
# Keeps covariances from being singular; far below the spread of any group that has one.
FLOORS = (1e-3, 1e-3, 1e-3, 1e-3, 1e-3)
DIMENSIONS = len(FLOORS)
# Normal quantile of the share of regular rows that may be rejected (1 in 100,000).
CUTOFF_Z = 4.265


def chi_square(z: float, k: int = DIMENSIONS) -> float:
    """Quantile of the chi-square distribution (Wilson-Hilferty)."""
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def base_counts(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    raw = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.trim(raw, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))
    lines = F.filter(F.split(raw, "\n", -1), lambda line: F.trim(line, F.lit(WHITE)) != "")
    first = df.select(
        *keep,
        words.alias("_words"),
        lines.alias("_lines"),
        (F.char_length(raw) - F.char_length(F.translate(raw, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    names = [c for c in first.columns if c not in ("_words", "_lines")]
    second = first.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    names = [c for c in second.columns if c != "_hashes"]
    # get(), not an index error, ends the last windows; there are none below WINDOW words
    window = F.transform(
        F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(F.col("_hashes"), i + k) for k in range(1, WINDOW)]),
    )
    third = second.select(*names, window.alias("_windows"))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(
        repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    fourth = third.select(*names, placed.alias("_placed"))
    again = F.filter(
        "_placed",
        lambda x, i: (F.get(F.col("_placed"), i - 1)["h"] == x["h"])
        | F.coalesce(F.get(F.col("_placed"), i + 1)["h"] == x["h"], F.lit(False)),
    )
    fifth = fourth.select(*names, F.array_sort(F.transform(again, lambda x: x["i"])).alias("_at"))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    return fifth.select(*names, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def vector() -> list[Column]:
    """The transformed statistics of a row with words."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log(chars / n),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def resolution() -> list[Column]:
    """Variance that each statistic of a row has from its own counts, as of Poisson counts
    (word lengths: half the mean as deviation; a window that comes twice has 2 * WINDOW words)."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [1.0 / (n + 1), 0.25 / n, 0.25 / chars, 0.25 / F.greatest("n_lines", F.lit(1)), 0.5 * WINDOW / n]


X = [f"_x{i}" for i in range(DIMENSIONS)]
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def distance(root: str = "_l") -> Column:
    """Squared distance of a row from its group's centre ``_m*`` under the lower triangular
    root (``_l*``) of the covariance, by forward substitution."""
    z: list[Column] = []
    for i in range(DIMENSIONS):
        value = F.col(X[i]) - F.col(f"_m{i}")
        for j in range(i):
            value = value - F.col(f"{root}{i}{j}") * z[j]
        z.append(value / F.col(f"{root}{i}{i}"))
    total = z[0] * z[0]
    for part in z[1:]:
        total = total + part * part
    return total


def resolved(rows: DataFrame) -> DataFrame:
    """``rows`` with their groups' estimates, plus the root ``_r*`` of the covariance and the
    row's own resolution: a sign that a short text shows by one count is no outlier."""
    out, own = rows, resolution()
    for i, j in PAIRS:
        cov = own[i] if i == j else F.lit(0.0)
        for k in range(j + 1):
            cov = cov + F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
        for k in range(j):
            cov = cov - F.col(f"_r{i}{k}") * F.col(f"_r{j}{k}")
        out = out.withColumn(f"_r{i}{j}", F.sqrt(cov) if i == j else cov / F.col(f"_r{j}{j}"))
    return out


def rooted(sums: DataFrame) -> DataFrame:
    """Centre and triangular root of the covariance plus floors, from sums about ``_c*``."""
    out = sums
    for i in range(DIMENSIONS):
        out = out.withColumn(f"_d{i}", F.col(f"_s{i}") / F.col("_n"))
    for i, j in PAIRS:
        cov = F.col(f"_p{i}{j}") / F.col("_n") - F.col(f"_d{i}") * F.col(f"_d{j}")
        for k in range(j):
            cov = cov - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
        if i == j:
            out = out.withColumn(f"_l{i}{i}", F.sqrt(F.greatest(cov + FLOORS[i] ** 2, F.lit(FLOORS[i] ** 2))))
        else:
            # the floors stand on the diagonal alone
            out = out.withColumn(f"_l{i}{j}", cov / F.col(f"_l{j}{j}"))
    return out.select(
        "_group",
        *[(F.col(f"_c{i}") + F.col(f"_d{i}")).alias(f"_m{i}") for i in range(DIMENSIONS)],
        *[f"_l{i}{j}" for i, j in PAIRS],
    )


def estimates(rows: DataFrame) -> DataFrame:
    """MCD centre, root and scale per ``_group`` of rows with the columns X."""
    middle = rows.groupBy("_group").agg(
        *[F.percentile_approx(x, 0.5, 10_000).alias(f"_m{i}") for i, x in enumerate(X)]
    )
    middle = small_side(cut(middle))
    spread = rows.join(middle, "_group").groupBy("_group").agg(
        *[
            F.greatest(
                1.4826 * F.percentile_approx(F.abs(F.col(x) - F.col(f"_m{i}")), 0.5, 10_000), F.lit(FLOORS[i])
            ).alias(f"_l{i}{i}")
            for i, x in enumerate(X)
        ]
    )
    now = middle.join(spread, "_group")
    for i, j in PAIRS:
        if i != j:
            now = now.withColumn(f"_l{i}{j}", F.lit(0.0))
    now = cut(now)
    for _ in range(STEPS):
        near = rows.join(small_side(now), "_group").withColumn("_d", distance())
        edge = cut(near.groupBy("_group").agg(F.percentile_approx("_d", H_SHARE, 10_000).alias("_edge")))
        kept = near.join(small_side(edge), "_group").where("_d <= _edge")
        centred = [F.col(x) - F.col(f"_m{i}") for i, x in enumerate(X)]
        sums = kept.groupBy("_group").agg(
            F.count("*").alias("_n"),
            *[F.first(f"_m{i}").alias(f"_c{i}") for i in range(DIMENSIONS)],
            *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(centred)],
            *[F.sum(centred[i] * centred[j]).alias(f"_p{i}{j}") for i, j in PAIRS],
        )
        now = cut(rooted(sums))
    scale = (
        resolved(rows.join(small_side(now), "_group"))
        .groupBy("_group")
        .agg(F.greatest(F.percentile_approx(distance("_r"), 0.5, 10_000) / chi_square(0.0), F.lit(1.0)).alias("_scale"))
    )
    return cut(now.join(scale, "_group"))


def assess_quality(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    min_words: int = 10,
    repeat_percent: int = 20,
) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, distance (of the judged rows, else NULL).

    ``base_failed``: fewer than ``min_words`` words, or more than ``repeat_percent`` % of
    the words in repeated windows. Those rows are rejected and teach the estimates nothing;
    a NULL text has no words. NULL languages and sources are groups of their own. Repeated
    rows each count. Ties at the edge of a concentration step are all in. An empty table
    gives an empty result. Texts are counted whole; other columns are not read.
    """
    keep = [
        quoted(id_column).alias("_id"),
        F.to_json(F.struct(quoted(lang_column).alias("l"), quoted(source_column).alias("s"))).alias("_group"),
    ]
    counted = base_counts(df.select(quoted(text_column).alias("_text"), *keep), "_text", [F.col("_id"), F.col("_group")])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    stats = cut(
        counted.withColumn("base_failed", failed).select(
            "*", *[x.alias(name) for x, name in zip(vector(), X, strict=True)]
        )
    )
    sizes = stats.groupBy("_group").agg(F.count_if(~F.col("base_failed")).alias("_rows"))
    stats = stats.join(small_side(cut(sizes)), "_group").withColumn(
        "_group", F.when(F.col("_rows") < MIN_GROUP, F.lit("")).otherwise(F.col("_group"))
    )
    found = estimates(stats.where(~F.col("base_failed")))
    judged = resolved(stats.join(small_side(found), "_group", "left")).withColumn(
        "distance", F.when(~F.col("base_failed"), distance("_r") / F.col("_scale"))
    )
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square(CUTOFF_Z), F.lit(True))
    return judged.select(
        F.col("_id").alias(id_column),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        kept.alias("kept"),
        "distance",
    )
