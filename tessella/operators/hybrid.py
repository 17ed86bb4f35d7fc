"""Hybrid retrieval: keyword and vector legs, normalised and fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.config import DEFAULT, RetrievalConfig
from tessella.functions import words as W
from tessella.operators.keyword import bm25
from tessella.operators.stored_index import KeywordIndex
from tessella.operators.stored_vectors import VectorTable
from tessella.operators.vectors import nearest, nearest_per_shelf
from tessella.scale import BROADCAST_ROWS, skew_join, top_per_group


def min_max(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Scale ``score`` to 0..1 inside each candidate list (at most the leg depth long)."""
    w = Window.partitionBy(*keys)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn(
        "norm",
        F.when(high - low < 1e-12, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)),
    )


def fuse(
    keyword_hits: DataFrame,
    vector_hits: DataFrame,
    k: int,
    config: RetrievalConfig = DEFAULT.retrieval,
    keys: tuple[str, ...] = ("qid",),
) -> DataFrame:
    """Weighted union of both candidate lists of each key: keys, ``id, seq, score, rank``."""
    keys = list(keys)
    left = min_max(keyword_hits, keys).select(*keys, "id", "seq", F.col("norm").alias("kw"))
    right = min_max(vector_hits, keys).select(*keys, "id", "seq", F.col("norm").alias("emb"))
    both = left.join(right, [*keys, "id", "seq"], "full").na.fill(0.0, ["kw", "emb"])
    scored = both.withColumn(
        "score",
        F.col("kw") * config.bm25_weight + F.col("emb") * config.vector_weight,
    ).where((F.col("emb") >= config.semantic_threshold) | (F.col("score") > 0))
    return top_per_group(scored, keys, [F.round("score", 9).desc(), F.col("seq").asc()], k)


def retrieve_per_shelf(
    fragments: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    query_vectors: DataFrame,
    top_k: int = 3,
    config: RetrievalConfig = DEFAULT.retrieval,
) -> DataFrame:
    """Hybrid hits of every shelf with its own word statistics and scales: ``qid, shelf, id,
    seq, score, rank``. ``vectors`` has shelf, id, seq and vec; shelves need a name."""
    depth = leg_depth(top_k, config)
    keyword_hits = bm25(fragments, queries, depth, by_shelf=True, config=config)
    vector_hits = nearest_per_shelf(vectors, query_vectors, depth)
    return fuse(keyword_hits, vector_hits, top_k, config, ("qid", "shelf"))


def retrieve(
    fragments: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    query_vectors: DataFrame,
    top_k: int | None = None,
    config: RetrievalConfig = DEFAULT.retrieval,
) -> DataFrame:
    k = top_k or config.top_k
    depth = leg_depth(k, config)
    keyword_hits = bm25(fragments, queries, depth, config=config)
    vector_hits = nearest(vectors, query_vectors, depth)
    return fuse(keyword_hits, vector_hits, k, config)


def leg_depth(k: int, config: RetrievalConfig = DEFAULT.retrieval) -> int:
    """Rows that each leg hands to the fusion."""
    return max(2 * k, config.min_leg_depth)


def retrieve_stored(
    index: KeywordIndex, vectors: VectorTable, queries: DataFrame, query_vectors: DataFrame, top_k: int | None = None
) -> DataFrame:
    """As ``retrieve``, from stored tables."""
    k = top_k or index.config.top_k
    depth = leg_depth(k, index.config)
    return fuse(index.search(queries, depth), vectors.search(query_vectors, depth), k, index.config)


def attach(hits: DataFrame, fragments: DataFrame, columns: list[str], bound: int) -> DataFrame:
    """Fetch fragment columns for a hit list of at most ``bound`` rows."""
    if bound <= BROADCAST_ROWS:
        return fragments.select("id", *columns).join(F.broadcast(hits), "id")
    return skew_join(hits, fragments.select("id", *columns), ["id"], "inner", ["qid"])


def compose_answers(
    hits: DataFrame, fragments: DataFrame, queries: DataFrame, k: int = DEFAULT.retrieval.top_k
) -> DataFrame:
    """Answer text per query: hits by quality, ties in retrieval order.

    A query gathers at most its top-k rows, so the ordered list stays short.
    """
    rows = attach(hits, fragments, ["content", "topic", "quality"], queries.count() * k)
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("quality")).alias("q"), "rank", "topic", "content", F.col("quality").alias("quality")
            )
        )
    )
    lists = rows.groupBy("qid").agg(ordered.alias("rows"))
    return (
        queries.join(lists, "qid", "left")
        .withColumn("answer", answer_text(F.col("rows"), F.col("text")))
        .select("qid", F.coalesce(F.size("rows"), F.lit(0)).alias("n"), "answer")
    )


def answer_text(rows, query):
    heading = F.concat(
        F.lit("Based on "),
        F.size(rows).cast("string"),
        F.lit(" relevant memory fragment(s), here is a synthesized response:\n\n"),
    )
    blocks = F.transform(
        rows,
        lambda r, i: F.concat(
            F.lit("--- Fragment "),
            (i + 1).cast("string"),
            F.lit(": ["),
            F.when(r["topic"] == "", F.lit("untitled")).otherwise(r["topic"]),
            F.lit("] (quality: "),
            F.round(r["quality"], 3).cast("string"),
            F.lit(") ---\n"),
            r["content"],
            F.lit("\n\n"),
        ),
    )
    full = F.concat(
        heading,
        F.array_join(blocks, ""),
        F.lit("--- End of response for: "),
        query,
        F.lit(" ---"),
    )
    return F.when(
        rows.isNull() | (F.size(rows) == 0),
        F.concat(F.lit("No relevant fragments found for query: "), query),
    ).otherwise(W.strip(full))


def conflict_warning(fragment_id, other_id, similarity, method):
    """One warning line of an answer with conflicts."""
    return F.concat(
        F.lit("⚠ Conflict detected: "),
        fragment_id,
        F.lit(" vs "),
        other_id,
        F.lit(" (similarity: "),
        W.percent(similarity),
        F.lit("%, method: "),
        method,
        F.lit(")"),
    )


def with_warnings(answer, warnings):
    """Append warning lines to an answer, if there are any."""
    return F.when(
        F.size(F.coalesce(warnings, F.array().cast("array<string>"))) > 0,
        F.concat(
            answer, F.lit("\n\n--- Conflict Warnings ---\n"), F.array_join(warnings, "\n")
        ),
    ).otherwise(answer)


def appeal_answer(answer, appeal_id, status, proposal, query):
    """An approved proposal replaces the composed answer."""
    return F.when(
        (status == "approved") & (F.coalesce(proposal, F.lit("")) != ""),
        F.concat(
            F.lit("An approved appeal ("),
            appeal_id,
            F.lit(") was applied to synthesise the following response for: "),
            query,
            F.lit("\n\n"),
            W.strip(proposal),
        ),
    ).otherwise(answer)
