"""Keyword search: inverted index and Okapi BM25 over a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.config import DEFAULT, RetrievalConfig
from tessella.functions import words as W
from tessella.operators.inrow import bounded_weights, top_rows
from tessella.scale import exploded, small_side, top_per_group

EVERYTHING = "_all"
ROW_MARK = ""  # pseudo term that every indexed row has once


def build_postings(fragments: DataFrame, by_shelf: bool = False) -> DataFrame:
    """Inverted index ``(shelf, term, id, seq, dl, tf)``; token-free rows have no entry.

    Every row also has one entry under the empty term, so row counts and lengths
    per shelf come from the same pass over the texts.
    """
    return _count_terms(_tokenised(fragments, by_shelf))


def write_index(fragments: DataFrame, path: str, by_shelf: bool = True) -> None:
    """Persist the index sorted by term, so a reader skips row groups of other terms."""
    (
        build_postings(fragments, by_shelf)
        .repartitionByRange("term", "id")
        .sortWithinPartitions("term", "id")
        .write.mode("overwrite")
        .parquet(path)
    )


def search_index(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 5,
    config: RetrievalConfig = DEFAULT.retrieval,
) -> DataFrame:
    """BM25 over a persisted index."""
    terms = query_terms(queries)
    wanted, _ = _wanted(terms)
    matched = spark.read.parquet(path).join(wanted, "term", "left_semi")
    return _rank(_score(terms, None, matched, config), k)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(qid, term, qtf)``: a repeated query word counts repeatedly."""
    return (
        queries.select("qid", F.explode(W.tokens(F.col("text"))).alias("term"))
        .groupBy("qid", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25(
    fragments: DataFrame,
    queries: DataFrame,
    k: int = 5,
    by_shelf: bool = False,
    config: RetrievalConfig = DEFAULT.retrieval,
) -> DataFrame:
    """Top ``k`` rows per query (and shelf): ``qid, shelf, id, seq, score, rank``.

    Two passes over the texts: the first counts the rows of each query word, the second
    scores whole rows inside their task and shuffles k rows per query and task. A batch
    with too many query words to hold in a task joins postings instead.
    """
    terms = query_terms(queries)
    rows = _rows(fragments, by_shelf)
    weights = bounded_weights(_weights(terms, _row_counts(rows, terms)))
    if weights is None:
        matched = build_postings(fragments, by_shelf).join(
            terms.select("term").distinct().unionByName(_mark(terms)), "term", "left_semi"
        )
        return _rank(_score(terms, None, matched, config), k)
    k1, b = config.k1, config.b

    def saturation(times, size, own):
        return times * (k1 + 1) / (times + k1 * (1 - b + b * size / own.mean_size))

    return _rank(top_rows(rows, weights, k, saturation), k)


def _rows(fragments: DataFrame, by_shelf: bool) -> DataFrame:
    shelf = F.col("shelf") if by_shelf else F.lit(EVERYTHING)
    rows = fragments.select(shelf.alias("shelf"), "id", "seq", W.tokens(F.col("content")).alias("toks"))
    return rows.withColumn("size", F.size("toks")).where("size > 0")


def _row_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``shelf, term, df, docs, avgdl`` of the query words."""
    wanted = small_side(terms.select("term").distinct())
    found = rows.select("shelf", F.explode(F.array_distinct("toks")).alias("term")).join(wanted, "term")
    counts = found.groupBy("shelf", "term").agg(F.count("*").alias("df"))
    shelves = rows.groupBy("shelf").agg(F.count("*").alias("docs"), F.avg("size").alias("avgdl"))
    return counts.join(shelves, "shelf")


def _weights(terms: DataFrame, counts: DataFrame) -> DataFrame:
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return terms.join(counts, "term").select(
        "shelf", "term", "qid", (F.col("qtf") * idf).alias("w"), F.col("avgdl").alias("mean_size")
    )


def _mark(terms: DataFrame) -> DataFrame:
    return terms.sparkSession.createDataFrame([(ROW_MARK,)], "term string")


def _wanted(terms: DataFrame) -> tuple[DataFrame, int]:
    """Terms to keep (query terms and the row mark) and the (qid, term) row count."""
    n = terms.count()
    return small_side(terms.select("term").distinct().unionByName(_mark(terms)), n + 1), n


def _tokenised(fragments: DataFrame, by_shelf: bool) -> DataFrame:
    shelf = F.col("shelf") if by_shelf else F.lit(EVERYTHING)
    rows = fragments.select(
        shelf.alias("shelf"), "id", "seq", W.tokens(F.col("content")).alias("toks")
    ).withColumn("dl", F.size("toks"))
    marked = F.when(F.col("dl") > 0, F.array_append("toks", F.lit(ROW_MARK)))
    return exploded(rows, marked, "term").drop("toks")


def _count_terms(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("shelf", "term", "id", "seq", "dl").agg(F.count(F.lit(1)).alias("tf"))


def _score(
    terms: DataFrame, bound: int | None, matched: DataFrame, config: RetrievalConfig
) -> DataFrame:
    k1, b = config.k1, config.b
    # reads the same columns as the scoring branch below, so both share one shuffle
    per_term = matched.groupBy("shelf", "term").agg(
        F.sum(F.least(F.col("tf"), F.lit(1))).alias("df"), F.avg("dl").alias("mean_dl")
    )
    shelf = Window.partitionBy("shelf")
    is_mark = F.col("term") == ROW_MARK
    weights = (
        per_term.withColumn("docs", F.max(F.when(is_mark, F.col("df"))).over(shelf))
        .withColumn("avgdl", F.max(F.when(is_mark, F.col("mean_dl"))).over(shelf))
        .withColumn(
            "idf", F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        )
    )
    # query terms carry their weight, so postings meet one narrow side only
    weighted = terms.join(weights, "term").select(
        "shelf", "term", "qid", "avgdl", (F.col("qtf") * F.col("idf")).alias("w")
    )
    saturation = (
        F.col("tf")
        * (k1 + 1)
        / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    )
    side = weighted if bound is None else small_side(weighted, bound)
    return (
        matched.join(side, ["shelf", "term"])
        .groupBy("qid", "shelf", "id", "seq")
        .agg(F.sum(F.col("w") * saturation).alias("score"))
    )


def _rank(scored: DataFrame, k: int) -> DataFrame:
    return top_per_group(
        scored, ["qid", "shelf"], [F.round("score", 9).desc(), F.col("seq").asc()], k
    )
