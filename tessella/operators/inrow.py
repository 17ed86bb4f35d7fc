"""Scores of whole rows against a query batch, with the top k per query kept in each task.

All words of a row are at hand in one task, so its scores need no shuffle: a task holds
the weights of the query words, of checked size, scores its rows against all queries at
once, and passes on k rows per query (and shelf).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessella.scale import BROADCAST_ROWS

# Cells of a score table (rows times queries), and words of rows, that a task handles at once.
CELLS = 500_000
WORDS = 1 << 18


@dataclass
class Weights:
    """Weights of one shelf: its words, and for each the queries that have it, word by word."""

    words: pa.Array
    queries: np.ndarray
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    mean_size: float
    query_sizes: np.ndarray


def bounded_weights(weights: DataFrame, sizes: DataFrame | None = None) -> dict[str, Weights] | None:
    """Weights by shelf from rows (shelf, term, qid, w, mean_size); ``sizes`` has (qid, n).

    None if there are more than BROADCAST_ROWS of them: then they must not be held whole.
    """
    held = weights.limit(BROADCAST_ROWS + 1).toPandas()
    if len(held) > BROADCAST_ROWS:
        return None
    of = dict(sizes.toPandas().itertuples(index=False, name=None)) if sizes is not None else {}
    out = {}
    for shelf, rows in held.groupby("shelf"):
        words, word = np.unique(rows["term"].to_numpy(), return_inverse=True)
        queries, query = np.unique(rows["qid"].to_numpy(), return_inverse=True)
        order = np.argsort(word, kind="stable")
        out[shelf] = Weights(
            pa.array(words, pa.string()), queries, np.searchsorted(word[order], np.arange(len(words) + 1)), query[order],
            rows["w"].to_numpy(np.float64)[order], float(rows["mean_size"].iloc[0]), np.array([of.get(q, 1) for q in queries], float),
        )
    return out


def _parts(batches: Iterator[pa.RecordBatch], weights: dict[str, Weights]) -> Iterator[tuple[Weights, str, pa.RecordBatch]]:
    """Rows of one shelf that have weights, about WORDS words of the batch at a time.

    Words stay in Arrow's memory, so that a worker holds little beyond the batch it was sent.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("toks")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        first = 0
        while first < len(ends):
            before = ends[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, before + WORDS, side="right")))
            some = batch.slice(first, last - first)
            shelves = some.column("shelf")
            for shelf in shelves.unique().to_pylist():
                if shelf in weights:
                    yield weights[shelf], shelf, some.filter(pc.equal(shelves, shelf))
            first = last


def _cells(rows: pa.RecordBatch, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, times) of the rows' words that some query has, by row."""
    sizes = pc.fill_null(pc.list_value_length(rows.column("toks")), 0).to_numpy(zero_copy_only=False)
    words = rows.column("toks").flatten()
    found = pc.fill_null(pc.index_in(words, value_set=weights.words.cast(words.type)), -1).to_numpy(zero_copy_only=False)
    here = found >= 0
    width = max(len(weights.words), 1)
    cell, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[here] * width + found[here], return_counts=True)
    return cell // width, cell % width, times


def _scores(rows: pa.RecordBatch, weights: Weights, value) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores of rows x queries) for blocks of rows."""
    row, word, times = _cells(rows, weights)
    return score_tables(row, word, value(times, _numbers(rows, "size")[row], weights), rows.num_rows, weights)


def score_tables(row: np.ndarray, word: np.ndarray, part: np.ndarray, n: int, weights: Weights) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores of rows x queries) for blocks of ``n`` rows, from what each word
    counts in each row, by row."""
    each = weights.start[word + 1] - weights.start[word]  # queries that have the word
    width = len(weights.queries)
    bounds = np.searchsorted(row, np.arange(n + 1))
    load = np.concatenate([[0], np.cumsum(each)])[bounds] + width * np.arange(n + 1)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(load, load[first] + CELLS, side="right")) - 1)
        a, b = bounds[first], bounds[last]
        cell = np.repeat(np.arange(a, b), each[a:b])
        place = np.arange(len(cell)) - np.repeat(np.cumsum(each[a:b]) - each[a:b], each[a:b]) + weights.start[word[cell]]
        key = (row[cell] - first) * width + weights.query[place]
        table = np.bincount(key, part[cell] * weights.weight[place], (last - first) * width)
        yield first, table.reshape(last - first, width)
        first = last


def _numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False)


class Best:
    """The k best rows of each query among those added: score rounded to nine digits, then seq."""

    def __init__(self, weights: Weights, k: int, least: float = 0.0):
        self.queries, self.k, self.least = weights.queries, k, least
        self.kept: dict[int, tuple] = {}
        self.edge = np.zeros(len(weights.queries))  # the k-th value of each query so far

    def add(self, table: np.ndarray, seq: np.ndarray, ids: pa.Array) -> None:
        """Scores of rows x queries with the rows' seq and id."""
        rounded = np.round(table, 9)
        wanted = (rounded > 0) & (table >= self.least) & (rounded >= self.edge)
        for j in np.flatnonzero(wanted.any(axis=0)).tolist():
            at, column = np.flatnonzero(wanted[:, j]), rounded[:, j]
            if len(at) > self.k:  # the k-th value and all ties with it
                low = np.partition(column[at], len(at) - self.k)[len(at) - self.k]
                at = at[column[at] >= low]
            found = (table[at, j], seq[at], ids.take(pa.array(at)).to_pylist())
            self.kept[j] = self._first([found, self.kept[j]] if j in self.kept else [found])
            if len(self.kept[j][0]) == self.k:
                self.edge[j] = np.round(self.kept[j][0][-1], 9)

    def _first(self, held: list[tuple]) -> tuple:
        score, seq = (np.concatenate([h[i] for h in held]) for i in range(2))
        ids = [x for h in held for x in h[2]]
        order = np.lexsort((seq, -np.round(score, 9)))[: self.k]
        return score[order], seq[order], [ids[i] for i in order]

    def rows(self) -> pa.Table:
        """``qid, id, seq, score``."""
        parts = [
            pa.table({"qid": pa.array([self.queries[j]] * len(ids), pa.int64()), "id": pa.array(ids, pa.string()),
                      "seq": pa.array(seq, pa.int64()), "score": pa.array(score, pa.float64())})
            for j, (score, seq, ids) in self.kept.items()
        ]
        schema = pa.schema([("qid", pa.int64()), ("id", pa.string()), ("seq", pa.int64()), ("score", pa.float64())])
        return pa.concat_tables(parts) if parts else schema.empty_table()


def top_rows(rows: DataFrame, weights: dict[str, Weights], k: int, value, finish=None, least: float = 0.0) -> DataFrame:
    """``qid, id, seq, score, shelf``: per task the k best of each query and shelf.

    ``rows`` has shelf, id, seq, toks and size; ``value(times, size, weights)`` is what a
    word found so often in a row of that size counts, ``finish(scores, size, weights)``
    the last step, ``least`` the smallest score kept (0: any above 0). Order: score rounded
    to nine digits, then seq.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Best] = {}
        for own, shelf, part in _parts(batches, weights):
            if shelf not in kept:
                kept[shelf] = Best(own, k, least)
            seq, ids, size = _numbers(part, "seq"), part.column("id"), _numbers(part, "size")
            for first, table in _scores(part, own, value):
                last = first + len(table)
                if finish is not None:
                    table = finish(table, size[first:last], own)
                kept[shelf].add(table, seq[first:last], ids.slice(first, len(table)))
        for shelf, best in kept.items():
            found = best.rows()
            yield from found.append_column("shelf", pa.array([shelf] * found.num_rows, pa.string())).to_batches()

    return rows.select("shelf", "id", "seq", "toks", "size").mapInArrow(
        task, "qid long, id string, seq long, score double, shelf string"
    )


def counted_rows(rows: DataFrame, weights: dict[str, Weights], value, finish, least: float) -> DataFrame:
    """``qid, n``: rows that reach ``least`` with each query, counted inside the tasks; one
    row per query, shelf and task, to be summed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for own, shelf, part in _parts(batches, weights):
            total = totals.setdefault(shelf, np.zeros(len(own.queries), np.int64))
            size = _numbers(part, "size")
            for first, table in _scores(part, own, value):
                table = finish(table, size[first : first + len(table)], own)
                total += ((table > 0) & (table >= least)).sum(axis=0)
        for shelf, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(weights[shelf].queries, pa.int64()), pa.array(total)], names=["qid", "n"])

    return rows.select("shelf", "id", "seq", "toks", "size").mapInArrow(task, "qid long, n long")
