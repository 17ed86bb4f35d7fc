"""Dense vectors: fallback embeddings and exact nearest neighbours."""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.scale import is_small, top_per_group

FALLBACK_DIM = 384
QUERY_ROWS = 4096  # query vectors that one task holds as a matrix
HITS = "qid long, id string, seq long, score double"


def char_sum_seed(text: str) -> int:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    places = np.arange(1, len(codes) + 1, dtype=np.int64)
    return int(((codes * places) % (2**31 - 1)).sum() % (2**31 - 1))


def md5_seed(text: str) -> int:
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:8], 16)


def seed_column(kind: str = "index") -> Callable:
    """Seed of the fallback vector of a text."""
    seed_of = char_sum_seed if kind == "index" else md5_seed

    @F.pandas_udf("long")
    def seeds(texts: pd.Series) -> pd.Series:
        return texts.map(seed_of)

    return seeds


def _unit_noise(seed: int, dim: int, source: np.random.RandomState) -> np.ndarray:
    source.seed(seed)  # as a new RandomState(seed), which takes ten times as long to make
    raw = source.randn(dim)
    size = np.linalg.norm(raw)
    return raw / size if size > 0 else raw


def fallback_embedder(kind: str = "index", dim: int = FALLBACK_DIM) -> Callable:
    """Deterministic unit vectors; ``index`` and ``conflict`` use different seeds."""
    seed_of = char_sum_seed if kind == "index" else md5_seed

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        source = np.random.RandomState()
        for batch in batches:
            yield batch.map(lambda text: _unit_noise(seed_of(text), dim, source))

    return embed


def with_vectors(fragments: DataFrame, embed: Callable, text: str = "content") -> DataFrame:
    """Attach ``vec`` from any embedder given as a column function."""
    return fragments.withColumn("vec", embed(F.col(text)))


def _best(qids: np.ndarray, scores: np.ndarray, ids, seqs, k: int) -> pd.DataFrame:
    """Top ``k`` columns per score row, ties by ``seqs``."""
    rounded = np.round(scores, 9)
    seq_row = np.asarray(seqs, dtype=np.int64)
    out = []
    for row, qid in enumerate(qids):
        order = np.lexsort((seq_row, -rounded[row]))[:k]
        out.append(
            pd.DataFrame(
                {"qid": qid, "id": ids[order], "seq": seq_row[order], "score": scores[row][order]}
            )
        )
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
        columns=["qid", "id", "seq", "score"]
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top ``k`` per query by dot product: ``qid, id, seq, score, rank``.

    Each task multiplies its batches with the query matrix and passes on ``k``
    rows per query, so the shuffle is independent of the table size. A query set
    too large for one matrix is cut into blocks that meet the vectors block by
    block.
    """
    slim = vectors.select("id", "seq", "vec")
    if is_small(queries, QUERY_ROWS):
        rows = queries.select("qid", "vec").collect()  # at most QUERY_ROWS, just counted
        if not rows:
            partial = slim.sparkSession.createDataFrame([], HITS)
        else:
            qids = np.array([r["qid"] for r in rows])
            matrix = np.array([r["vec"] for r in rows], dtype=np.float64)

            def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                best = None
                for batch in batches:
                    if batch.empty:
                        continue
                    scores = matrix @ np.stack(batch["vec"].to_numpy()).T
                    hits = _best(qids, scores, batch["id"].to_numpy(), batch["seq"], k)
                    best = hits if best is None else _trim(pd.concat([best, hits]), k)
                if best is not None:
                    yield best

            partial = slim.mapInPandas(scan, HITS)
    else:
        partial = _blockwise(slim, queries.select("qid", "vec"), k)
    return top_per_group(
        partial, ["qid"], [F.round("score", 9).desc(), F.col("seq").asc()], k
    )


def nearest_per_shelf(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top ``k`` per query and shelf: ``qid, shelf, id, seq, score, rank``.

    As ``nearest``, with k rows per query, shelf and task going on. Query batches beyond one
    matrix go block after block, each of which reads the vectors once.
    """
    slim = vectors.select("shelf", "id", "seq", "vec")
    n = queries.count()
    blocks = 1 if n <= QUERY_ROWS else 2 * -(-n // QUERY_ROWS)
    parts = []
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).select("qid", "vec").collect()
        qids = np.array([r["qid"] for r in own], np.int64)
        held = vectors.sparkSession.sparkContext.broadcast((qids, np.array([r["vec"] for r in own], np.float64)))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            qids, matrix = held.value
            best: dict[str, pd.DataFrame] = {}
            for batch in batches:
                for shelf, part in batch.groupby("shelf", dropna=False, sort=False):
                    if len(qids):
                        scores = matrix @ np.stack(part["vec"].to_numpy()).T
                        hits = _best(qids, scores, part["id"].to_numpy(), part["seq"], k)
                        best[shelf] = _trim(pd.concat([best[shelf], hits]), k) if shelf in best else hits
            for shelf, hits in best.items():
                yield hits.assign(shelf=shelf)

        parts.append(slim.mapInPandas(scan, f"{HITS}, shelf string"))
    found = reduce(DataFrame.unionByName, parts)
    return top_per_group(found, ["qid", "shelf"], [F.round("score", 9).desc(), F.col("seq").asc()], k)


def _trim(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = hits.assign(_s=hits["score"].round(9)).sort_values(
        ["qid", "_s", "seq"], ascending=[True, False, True]
    )
    return ordered.groupby("qid").head(k).drop(columns="_s")


def _blockwise(vectors: DataFrame, queries: DataFrame, k: int, rows: int = QUERY_ROWS) -> DataFrame:
    """Large query batches: query blocks x vector blocks, one matrix product each."""
    query_blocks = -(-queries.count() // rows)
    vector_blocks = max(1, -(-vectors.count() // (4 * rows)))
    # fresh column identities: both sides may come from one table
    queries = queries.select(F.col("qid").alias("qid"), F.col("vec").alias("q_vec"))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).cast("int"))
    q = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))))
    v = vectors.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(vector_blocks)).cast("int"))
    v = v.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def multiply(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["qid", "id", "seq", "score"])
        scores = np.stack(left["q_vec"].to_numpy()) @ np.stack(right["vec"].to_numpy()).T
        return _best(left["qid"].to_numpy(), scores, right["id"].to_numpy(), right["seq"], k)

    return (
        q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(multiply, HITS)
    )
