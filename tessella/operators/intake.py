"""Intake scan: certified candidates and aspect coverage for a query batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.config import DEFAULT, GateConfig, IntakeConfig
from tessella.functions import words as W
from tessella.operators.gate import is_certified
from tessella.operators.inrow import bounded_weights, counted_rows, top_rows
from tessella.operators.vectors import nearest
from tessella.scale import BROADCAST_ROWS, exploded, is_small, skew_join, small_side, top_per_group


def word_similarities(fragments: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, id, seq, sim`` for pairs that share a word (others score 0).

    Words meet a counted-small query side inside the scan; pair counts combine
    before the shuffle.
    """
    asked = queries.select("qid", W.word_set(F.col("text")).alias("ws"))
    asked = exploded(asked.withColumn("n", F.size("ws")), F.col("ws"), "word").drop("ws")
    stored = fragments.select("id", "seq", W.word_set(F.col("content")).alias("ws"))
    stored = exploded(stored.withColumn("m", F.size("ws")), F.col("ws"), "word").drop("ws")
    shared = (
        stored.join(small_side(asked), "word")
        .groupBy("qid", "id", "seq", "n", "m")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    return shared.select(
        "qid", "id", "seq", (F.col("shared") / F.least("n", "m")).alias("sim")
    )


def _held(queries: DataFrame) -> dict | None:
    """Words of the queries as they are held in a task; None if there are too many."""
    asked = queries.select("qid", W.word_set(F.col("text")).alias("ws"))
    words = asked.select(
        F.lit("").alias("shelf"), F.explode("ws").alias("term"), "qid", F.lit(1.0).alias("w"), F.lit(1.0).alias("mean_size")
    )
    return bounded_weights(words, asked.select("qid", F.size("ws").alias("n")))


def _word_rows(fragments: DataFrame) -> DataFrame:
    stored = fragments.select(F.lit("").alias("shelf"), "id", "seq", W.word_set(F.col("content")).alias("toks"))
    return stored.withColumn("size", F.size("toks"))


def _once(times, size, own):
    return np.ones(len(times))


def _share(shared, size, own):
    return shared / np.minimum(own.query_sizes[None, :], np.maximum(size, 1)[:, None])


def _similar(fragments: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """``qid, id, seq, sim``, at least every row of the top ``k`` per query.

    Rows are compared with all queries inside their task; only a batch with too many words
    to hold there shuffles pairs.
    """
    held = _held(queries)
    if held is None:
        return word_similarities(fragments, queries).where(F.col("sim") >= least)
    found = top_rows(_word_rows(fragments), held, k, _once, _share, least)
    return found.select("qid", "id", "seq", F.col("score").alias("sim"))


def candidates(
    fragments: DataFrame,
    queries: DataFrame,
    k: int,
    config: IntakeConfig = DEFAULT.intake,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
) -> DataFrame:
    """Top ``k`` rows per query at or above the similarity threshold.

    With vectors the similarity is the larger of word overlap and cosine. Each
    leg's own top ``k`` suffices: a row in the joint top ``k`` is in the top
    ``k`` of the leg that gives its larger value.
    """
    order = [F.round("sim", 9).desc(), F.col("seq").asc()]
    by_words = top_per_group(_similar(fragments, queries, k, config.candidate_threshold), ["qid"], order, k)
    if vectors is None:
        return by_words
    by_cosine = (
        nearest(vectors, query_vectors, k)
        .select("qid", "id", "seq", F.col("score").alias("sim"))
        .where(F.col("sim") >= config.candidate_threshold)
    )
    joint = (
        by_words.drop("rank")
        .unionByName(by_cosine)
        .groupBy("qid", "id", "seq")
        .agg(F.max("sim").alias("sim"))
    )
    return top_per_group(joint, ["qid"], order, k)


def aspect_hit(aspect: Column, row: Column) -> Column:
    low = F.lower(aspect)
    return (
        row["content_lc"].contains(low)
        | row["topic_lc"].contains(low)
        | F.exists(row["tags_lc"], lambda t: t.contains(low))
    )


def attach_details(details: DataFrame, picked: DataFrame, bound: int) -> DataFrame:
    """Join picked rows (at most ``bound``) with their details."""
    if bound <= BROADCAST_ROWS:
        return details.join(F.broadcast(picked), "id")
    return skew_join(picked, details, ["id"], "inner", ["qid"])


def gather(
    picked: DataFrame, fragments: DataFrame, queries: DataFrame, k: int,
    gate: GateConfig = DEFAULT.gate,
) -> DataFrame:
    """One row per query with its certified candidates in rank order.

    Runs after the top-k cut, so a query's list never exceeds ``k`` rows.
    """
    details = fragments.where(
        is_certified(F.col("quality"), F.col("provenance.final_source"), gate)
    ).select(
        "id",
        "content",
        "quality",
        "topic",
        "tags",
        F.lower("content").alias("content_lc"),
        F.lower("topic").alias("topic_lc"),
        F.transform("tags", F.lower).alias("tags_lc"),
    )
    bound = queries.count() * k
    row = F.struct(
        "rank", "id", "sim", "quality", "topic", "tags", "content", "content_lc", "topic_lc", "tags_lc"
    )
    lists = (
        attach_details(details, picked, bound)
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(row)).alias("certified"))
    )
    empty = F.filter(F.array(F.lit(None).cast(lists.schema["certified"].dataType.elementType)),
                     lambda r: r.isNotNull())
    return queries.join(lists, "qid", "left").withColumn(
        "certified", F.coalesce("certified", empty)
    )


def scan(
    fragments: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    config: IntakeConfig = DEFAULT.intake,
    gate: GateConfig = DEFAULT.gate,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
) -> DataFrame:
    """Candidates are cut to ``k`` first and filtered by certification second."""
    k = k or config.top_k
    picked = candidates(fragments, queries, k, config, vectors, query_vectors)
    gathered = gather(picked, fragments, queries, k, gate)
    return (
        gathered.withColumn("aspects", W.aspects(F.col("text"), config.min_aspects))
        .withColumn(
            "matched",
            F.filter(
                "aspects", lambda a: F.exists("certified", lambda c: aspect_hit(a, c))
            ),
        )
        .withColumn("missing", F.filter("aspects", lambda a: ~F.array_contains("matched", a)))
        .withColumn(
            "max_similarity",
            F.coalesce(F.array_max(F.transform("certified", lambda c: c["sim"])), F.lit(0.0)),
        )
        .withColumn(
            "should_proceed",
            (F.size("certified") > 0)
            & (F.size("matched") >= F.size("aspects") * F.lit(config.proceed_share)),
        )
    )


def certified_count(
    fragments: DataFrame, queries: DataFrame, config: IntakeConfig = DEFAULT.intake
) -> DataFrame:
    """Certified rows among the candidates of each query: all of them, or the first
    ``count_cap`` where the configuration sets one."""
    sure = fragments.where(is_certified(F.col("quality"), F.col("provenance.final_source")))
    held = None if config.count_cap is not None else _held(queries)
    if config.count_cap is not None:
        picked = candidates(fragments, queries, config.count_cap, config)
        found = attach_details(sure.select("id"), picked, queries.count() * config.count_cap).select(
            "qid", F.lit(1).cast("long").alias("n")
        )
    elif held is None:
        similar = word_similarities(sure, queries).where(F.col("sim") >= config.candidate_threshold)
        found = similar.select("qid", F.lit(1).cast("long").alias("n"))
    else:
        found = counted_rows(_word_rows(sure), held, _once, _share, config.candidate_threshold)
    counts = found.groupBy("qid").agg(F.sum("n").alias("n"))
    return queries.join(counts, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


def has_certified_for(
    fragments: DataFrame, queries: DataFrame, gate: GateConfig = DEFAULT.gate,
    config: IntakeConfig = DEFAULT.intake,
) -> DataFrame:
    """``qid, found``: some aspect occurs in some certified row of the whole archive.

    Distinct aspects are matched in one pass over the archive; each batch drops
    an aspect from its search once found and reports an aspect at most once.
    """
    asked = queries.select(
        "qid", F.explode(W.aspects(F.col("text"), config.min_aspects)).alias("aspect")
    ).withColumn("aspect", F.lower("aspect"))
    needles = asked.select("aspect").distinct()
    sure = fragments.where(
        is_certified(F.col("quality"), F.col("provenance.final_source"), gate)
    ).select(
        F.lower("content").alias("content"),
        F.lower("topic").alias("topic"),
        F.transform("tags", F.lower).alias("tags"),
    )
    found = find_substrings(sure, needles)
    hits = asked.join(found, "aspect").select("qid").distinct().withColumn("found", F.lit(True))
    return queries.join(hits, "qid", "left").select(
        "qid", F.coalesce("found", F.lit(False)).alias("found")
    )


NEEDLES_PER_PASS = 50_000


def find_substrings(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Needles that occur as a substring of some text column or tag.

    The needle set travels with the tasks while a count proves it small;
    otherwise it is spread over blocks and every block sees the texts.
    """
    def search(wanted, batches):
        import ahocorasick

        if "" in wanted:
            yield pd.DataFrame({"aspect": [""]})
        open_needles = {w for w in wanted if w}
        machine = None
        for batch in batches:
            if machine is None:
                if not open_needles:
                    return
                machine = ahocorasick.Automaton()
                for w in open_needles:
                    machine.add_word(w, w)
                machine.make_automaton()
            found = set()
            for content, topic, tags in zip(batch["content"], batch["topic"], batch["tags"]):
                for text in (content, topic, *tags):
                    for _, needle in machine.iter(text):
                        found.add(needle)
            fresh = found & open_needles
            open_needles -= fresh
            if fresh:
                yield pd.DataFrame({"aspect": sorted(fresh)})

    if is_small(needles, NEEDLES_PER_PASS):
        wanted = [r[0] for r in needles.collect()]  # counted above
        found = texts.mapInPandas(lambda b: search(wanted, b), "aspect string")
        return found.distinct()
    blocks = -(-needles.count() // NEEDLES_PER_PASS)
    grouped = needles.withColumn("b", F.pmod(F.xxhash64("aspect"), F.lit(blocks)).cast("int"))
    slices = max(blocks, texts.rdd.getNumPartitions())
    spread = texts.withColumn(
        "s", F.pmod(F.xxhash64("content"), F.lit(slices)).cast("int")
    ).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = grouped.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def per_block(key: tuple, words: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        out = list(search(list(words["aspect"]), [batch] if len(batch) else []))
        return pd.concat(out) if out else pd.DataFrame({"aspect": pd.Series(dtype=str)})

    return (
        left.groupBy("b", "s")
        .cogroup(spread.groupBy("b", "s"))
        .applyInPandas(per_block, "aspect string")
        .distinct()
    )
