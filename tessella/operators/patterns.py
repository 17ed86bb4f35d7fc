"""Recurring patterns: extraction, frequency, de-duplication, certification, feedback."""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import schemas
from tessella.config import DEFAULT, EngineConfig, PatternConfig
from tessella.functions import words as W
from tessella.operators.gate import admitted, guard, is_certified
from tessella.scale import (
    cut,
    exploded,
    running_position,
    shared_folder,
    skew_join,
    small_side,
    top_per_group,
    with_order_bucket,
)

OCCURRENCE = ["seq", "pos"]
# Rows of patterns, one for each of their first words, that are broadcast at once.
PATTERN_ROWS = 200_000


# -- extraction ------------------------------------------------------------------


def extract_phrases(texts: DataFrame, min_words: int = 10) -> DataFrame:
    """One row per phrase occurrence: ``type, name, content, context, hash, seq, pos``."""
    found = texts.select(
        "seq", "context", W.phrases(F.col("content"), min_words).alias("phrases")
    )
    return exploded(found, F.col("phrases"), "phrase", "pos").select(
        F.lit("phrase").alias("type"),
        W.phrase_name(F.col("phrase")).alias("name"),
        F.col("phrase").alias("content"),
        "context",
        F.lit("phrase").alias("tag"),
        F.sha2("phrase", 256).alias("hash"),
        "seq",
        "pos",
    )


def python_patterns(code: str) -> list[tuple[str, str, str, str]]:
    """(type, name, source, extra tag) of the reusable parts of a Python source."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found: dict[str, list] = {"definition": [], "constant": [], "library": []}

    def source(node) -> str:
        return ast.get_source_segment(code, node) or ""

    for node in ast.walk(tree):
        match node:
            case ast.FunctionDef(name=name) if len(source(node).splitlines()) >= 2:
                found["definition"].append(("function", name, source(node).strip(), ""))
            case ast.ClassDef(name=name) if len(source(node).splitlines()) >= 3:
                found["definition"].append(("function", name, source(node).strip(), "class"))
            case ast.Assign(targets=targets):
                found["constant"] += [
                    ("constant", t.id, source(node).strip(), "constant")
                    for t in targets
                    if isinstance(t, ast.Name) and t.id.isupper() and len(t.id) > 1
                ]
            case ast.Import(names=names):
                found["library"] += [
                    ("library", a.name, source(node).strip(), "import") for a in names
                ]
            case ast.ImportFrom(module=module, names=names):
                found["library"] += [
                    ("library", f"{module or ''}.{a.name}", source(node).strip(), "import")
                    for a in names
                ]
    return found["definition"] + found["constant"] + found["library"]


PATTERN_TYPE = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("type", "name", "content", "tag")])
)


@F.udf(PATTERN_TYPE)
def _python_patterns(code):
    return python_patterns(code) if code else []


def extract_code(texts: DataFrame) -> DataFrame:
    """Functions, constants and imports of Python sources, one row per occurrence."""
    found = texts.select("seq", "context", _python_patterns("content").alias("patterns"))
    return exploded(found, F.col("patterns"), "p", "pos").select(
        "p.type",
        "p.name",
        "p.content",
        "context",
        "p.tag",
        F.sha2(F.col("p.content"), 256).alias("hash"),
        "seq",
        "pos",
    )


def scan_documents(texts: DataFrame, kind: str = "text", min_words: int = 10) -> DataFrame:
    """Occurrences of all texts; ``auto`` sends texts that look like code to the code scan."""
    if kind == "code":
        return extract_code(texts)
    if kind == "auto":
        marked = texts.withColumn("_code", W.looks_like_code(F.col("content")))
        return extract_code(marked.where("_code")).unionByName(
            extract_phrases(marked.where("NOT _code"), min_words)
        )
    return extract_phrases(texts, min_words)


# -- frequency -------------------------------------------------------------------


def pattern_key(kind: Column, digest: Column) -> Column:
    return F.concat_ws(":", kind, F.substring(digest, 1, 12))


def base_threshold(kind: Column, config: PatternConfig = DEFAULT.patterns) -> Column:
    expr = F.when(F.lit(False), F.lit(0))
    for name, value in config.base_thresholds.items():
        expr = expr.when(kind == name, F.lit(value))
    return expr.otherwise(F.lit(4))


def trackers(occurrences: DataFrame, config: PatternConfig = DEFAULT.patterns) -> DataFrame:
    """Frequency per pattern; name and context are those of the first occurrence.

    Every aggregate combines before the shuffle, so a frequent pattern moves one
    row per task.
    """
    first = F.struct(*OCCURRENCE)
    return (
        occurrences.withColumn("key", pattern_key(F.col("type"), F.col("hash")))
        .groupBy("key", "type")
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.min_by("name", first).alias("name"),
            F.min_by("context", first).alias("context"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
        )
        .withColumn("threshold", base_threshold(F.col("type"), config))
        .withColumn("ready", (F.col("threshold") > 0) & (F.col("cnt") >= F.col("threshold")))
    )


def tracker_statistics(tracked: DataFrame) -> DataFrame:
    return tracked.groupBy("type").agg(
        F.count(F.lit(1)).alias("patterns"), F.count_if("ready").alias("ready")
    )


def similar_stored(
    patterns: DataFrame, fragments: DataFrame, config: EngineConfig = DEFAULT
) -> DataFrame:
    """Keys of patterns that the archive already holds in similar words.

    A pattern counts as held if a certified row is among its first few most
    similar rows with enough similarity. Only rows at or above that similarity
    can matter: they precede all others in the ranking.

    Pairs come from a prefix filter: of the smaller word set at most
    ``size - ceil(limit * size)`` words may be missing from the larger one, so one
    more word than that is enough to find every partner. The words that the fewest
    patterns have are taken; the choice does not affect results. Patterns go to the
    stored rows in blocks of bounded size, so no word of a stored row is shuffled.
    Words compare by 64-bit hashes.
    """
    depth, limit = config.patterns.dedup_depth, config.patterns.dedup_similarity

    def prefix(size: Column) -> Column:
        return (size - F.ceil(size * limit - 1e-9) + 1).cast("int")

    asked = patterns.select("key", hashed_words(F.col("content")).alias("ws"))
    words = cut(exploded(asked, F.col("ws"), "word").select("key", "word"))
    shared = words.groupBy("word").agg(F.count(F.lit(1)).alias("shared"))
    rare = F.transform(F.array_sort(F.collect_list(F.struct("shared", "word"))), lambda s: s["word"])
    ranked = words.join(shared, "word").groupBy("key").agg(rare.alias("pattern")).withColumn("n", F.size("pattern"))
    ranked = cut(ranked)
    sure = is_certified(F.col("quality"), F.col("provenance.final_source"), config.gate)
    stored = fragments.select("seq", sure.alias("sure"), hashed_words(F.col("content")).alias("ws")).withColumn("m", F.size("ws"))

    first = ranked.withColumn("word", F.explode(F.slice("pattern", F.lit(1), prefix(F.col("n")))))
    n_blocks = -(-first.count() // PATTERN_ROWS)
    folder = shared_folder(fragments.sparkSession, "stored-words")
    stored.write.parquet(folder)
    stored = fragments.sparkSession.read.parquet(folder)
    near = [_short_partners(ranked, words, shared, stored, prefix, limit, depth)]
    for block in range(n_blocks):
        part = first.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == block)
        met = exploded(stored, F.col("ws"), "word").join(F.broadcast(part), "word").where("n <= m")
        share = F.size(F.array_intersect("ws", "pattern")) / F.col("n")
        similar = met.select("key", "seq", "sure", share.alias("sim"))
        # a partner is met once for each of the first words that it has
        near.append(similar.where(F.col("sim") >= limit).distinct())
    best = [top_per_group(n, ["key"], [F.round("sim", 9).desc(), F.col("seq").asc()], depth).drop("rank") for n in near]
    ranking = top_per_group(
        reduce(DataFrame.unionByName, best), ["key"], [F.round("sim", 9).desc(), F.col("seq").asc()], depth
    )
    return ranking.where("sure").select("key").distinct()


def hashed_words(text: Column) -> Column:
    """Distinct words of a text as 64-bit hashes."""
    return F.array_distinct(F.transform(W.lower_words(text), lambda w: F.xxhash64(w)))


def _short_partners(ranked: DataFrame, words: DataFrame, shared: DataFrame, stored: DataFrame, prefix, limit: float, depth: int) -> DataFrame:
    """(key, seq, sure, sim) of stored rows with fewer words than the pattern. Rows with equal
    words tie, so of each set only the first few by ``seq`` are kept."""
    longest = ranked.agg(F.max("n")).first()[0] or 0
    short = stored.where(F.col("m").between(1, longest - 1)).withColumn("ws", F.array_sort("ws"))
    few = cut(top_per_group(short, ["ws"], [F.col("seq").asc()], depth, "copy"))
    sets = few.where("copy = 1").select(F.xxhash64("ws").alias("short_id"), "m", "ws")
    each = sets.select("short_id", "m", F.explode("ws").alias("word")).join(shared, "word", "left")
    rare = F.array_sort(F.collect_list(F.struct(F.coalesce("shared", F.lit(0)).alias("shared"), "word")))
    first = F.slice(rare, F.lit(1), prefix(F.col("m")))
    heads = each.groupBy("short_id", "m").agg(first.alias("first")).select("short_id", F.explode("first.word").alias("word"))
    pairs = words.join(heads, "word").select("key", "short_id").distinct()
    near = (
        pairs.join(ranked.select("key", "n", "pattern"), "key")
        .join(sets, "short_id")
        .where("m < n")
        .select("key", "ws", W.overlap_share(F.col("pattern"), F.col("ws")).alias("sim"))
        .where(F.col("sim") >= limit)
    )
    return near.join(few.select("ws", "seq", "sure"), "ws").select("key", "seq", "sure", "sim")


def candidates(
    occurrences: DataFrame, fragments: DataFrame, config: EngineConfig = DEFAULT
) -> DataFrame:
    """Occurrences at or past their threshold whose pattern is new to the archive.

    The archive is seen as it was before the scan. Numbering is split by position
    for patterns that occur very often.
    """
    keyed = occurrences.withColumn("key", pattern_key(F.col("type"), F.col("hash")))
    frequent = (
        keyed.groupBy("key", "type")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= base_threshold(F.col("type"), config.patterns))
        .select("key")
    )
    held = cut(keyed.join(small_side(cut(frequent)), "key", "left_semi"))
    numbered = running_position(held, ["key"], OCCURRENCE, "occurrence")
    due = cut(
        numbered.where(F.col("occurrence") >= base_threshold(F.col("type"), config.patterns))
    )
    distinct = cut(
        due.groupBy("key").agg(
            F.min_by("content", F.struct(*OCCURRENCE)).alias("content"),
            F.first("hash").alias("hash"),
        )
    )
    known = similar_stored(distinct, fragments, config).unionByName(
        _checksum_matches(distinct, fragments)
    )
    return due.join(known.distinct(), "key", "left_anti")


def _checksum_matches(patterns: DataFrame, fragments: DataFrame) -> DataFrame:
    """Patterns whose first eight hash digits occur inside a stored checksum.

    A checksum has sixteen digits, so its nine windows of eight turn the substring
    test into an equi-join.
    """
    windows = fragments.where(F.length("checksum") >= 8).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("checksum") - 7),
                lambda i: F.substring(F.col("checksum"), i, F.lit(8)),
            )
        ).alias("head")
    )
    heads = patterns.select("key", F.substring("hash", 1, 8).alias("head"))
    return windows.join(small_side(heads), "head").select("key").distinct()


def to_fragments(patterns: DataFrame) -> DataFrame:
    """Pattern rows as fragments with pattern-scan provenance."""
    tags = F.filter(
        F.array(F.nullif("context", F.lit("")), F.nullif("tag", F.lit(""))),
        lambda t: t.isNotNull(),
    )
    evaluation = F.struct(
        F.lit(None).cast("timestamp").alias("timestamp"),
        # fixed value: model name stored with mined patterns
        F.lit("rastrello").alias("model_id"),
        F.lit("1.0").alias("model_version"),
        F.lit(0.80).alias("score"),
        F.lit("rastrello_discovered").alias("source"),
        F.create_map(
            F.lit("pattern_type"), F.col("type"),
            F.lit("pattern_name"), F.col("name"),
            F.lit("context"), F.col("context"),
        ).alias("metadata"),
    ).cast(schemas.EVALUATION)
    provenance = F.struct(
        F.array(evaluation).alias("evaluations"),
        F.lit(0.80).alias("final_quality"),
        F.lit("rastrello_discovered").alias("final_source"),
        F.lit(None).cast("double").alias("consensus_score"),
        F.lit(None).cast("string").alias("consensus_method"),
    )
    return patterns.select(
        F.concat(F.lit("R-"), F.substring("hash", 1, 8)).alias("id"),
        "seq",
        "pos",
        "content",
        F.col("name").alias("topic"),
        F.lit(0.80).alias("quality"),
        F.concat(tags, F.array("type")).alias("tags"),
        F.concat(F.array(F.lower("name")), tags).alias("keywords"),
        F.concat(F.lit("rastrello:"), "context").alias("source"),
        F.lit("").alias("author"),
        F.array().cast("array<string>").alias("parents"),
        provenance.alias("provenance"),
    )


def certify(
    emitted: DataFrame,
    fragments: DataFrame,
    config: EngineConfig = DEFAULT,
    vote=None,
) -> DataFrame:
    """Emitted patterns that pass the optional vote and the gate, one row per new id.

    ``vote`` maps a fragment table to its accepted rows.
    """
    rows = to_fragments(emitted)
    if vote is not None:
        rows = vote(rows)
    passed = admitted(guard(rows, config.gate))
    one = passed.groupBy("id").agg(
        F.min_by(F.struct(*[F.col(c) for c in passed.columns if c != "id"]), F.struct(*OCCURRENCE)).alias("r")
    ).select("id", "r.*")
    return one.join(fragments.select("id"), "id", "left_anti")


# -- feedback --------------------------------------------------------------------


def adapt_thresholds(
    events: DataFrame,
    state: DataFrame,
    config: PatternConfig = DEFAULT.patterns,
    buckets: int | None = None,
) -> DataFrame:
    """Fold usage signals (``key, ts, seq, action``) into thresholds per key.

    Each signal is the function ``x -> max(min(max(x + d, low), high), floor)``,
    where ``d`` follows from running counts and ``floor`` from the occurrences.
    Such functions are closed under composition as (shift, low, high), so each
    key and time bucket is folded on its own and the few bucket results are
    composed afterwards. A key that owns most events is thereby spread over many
    tasks, yet the result equals the one-by-one fold.
    """
    used = (F.col("action") == "used").cast("int")
    ignored = (F.col("action") == "ignored").cast("int")
    bucketed = with_order_bucket(events, "ts", buckets)
    totals = bucketed.groupBy("key", "_bucket").agg(
        F.sum(used).alias("_u"), F.sum(ignored).alias("_i")
    )
    before = Window.partitionBy("key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "key",
        "_bucket",
        F.coalesce(F.sum("_u").over(before), F.lit(0)).alias("_u0"),
        F.coalesce(F.sum("_i").over(before), F.lit(0)).alias("_i0"),
    )
    inside = (
        Window.partitionBy("key", "_bucket").orderBy("ts", "seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = (
        bucketed.withColumn("_ru", F.sum(used).over(inside))
        .withColumn("_ri", F.sum(ignored).over(inside))
        .join(offsets, ["key", "_bucket"])
    )
    drift = (F.col("_u0") + F.col("_ru")) * F.lit(config.used_delta) + (
        F.col("_i0") + F.col("_ri")
    ) * F.lit(config.ignored_delta)
    shift = F.when(F.col("action") == "confirmed", F.bround(F.lit(config.confirmed_delta), 0)).otherwise(
        F.bround(drift, 0)
    )
    floors = state.select("key", (F.col("occurrences") + 1).cast("double").alias("_floor"))
    low, high = F.lit(float(config.threshold_min)), F.lit(float(config.threshold_max))
    steps = skew_join(
        counted.select("key", "_bucket", "ts", "seq", "action", shift.alias("a")),
        floors, ["key"], "inner", ["seq"],
    ).withColumn("lo", F.greatest(low, "_floor")).withColumn("hi", F.greatest(high, "_floor"))
    folded = (
        steps.groupBy("key", "_bucket")
        .agg(_compose(F.collect_list(F.struct("ts", "seq", "a", "lo", "hi"))).alias("f"),
             *_tallies())
        .groupBy("key")
        .agg(
            _compose(F.collect_list(F.struct("_bucket", F.col("f.a"), F.col("f.lo"), F.col("f.hi")))).alias("f"),
            *[F.sum(n).alias(n) for n in ("used", "ignored", "confirmed")],
        )
    )
    start = F.col("threshold").cast("double")
    end = F.least(F.greatest(start + F.col("f.a"), F.col("f.lo")), F.col("f.hi"))
    return state.join(folded, "key", "left").select(
        "key",
        "occurrences",
        F.coalesce(end, start).cast("long").alias("threshold"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("used", "ignored", "confirmed")],
    )


def _tallies() -> list[Column]:
    return [F.count_if(F.col("action") == n).alias(n) for n in ("used", "ignored", "confirmed")]


def _compose(steps: Column) -> Column:
    """Compose clamp-and-shift steps in the order of their leading fields."""
    identity = F.struct(
        F.lit(0.0).alias("a"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")
    )

    def then(acc: Column, nxt: Column) -> Column:
        lo = F.least(F.greatest(acc["lo"] + nxt["a"], nxt["lo"]), nxt["hi"])
        hi = F.least(F.greatest(acc["hi"] + nxt["a"], nxt["lo"]), nxt["hi"])
        return F.struct((acc["a"] + nxt["a"]).alias("a"), lo.alias("lo"), hi.alias("hi"))

    return F.aggregate(F.array_sort(steps), identity, then)
