"""Periodic runs of words from Lyndon roots.

Phase one of Baier's suffix sorter keeps the suffixes of a sequence in groups, takes the
highest group, finds for each of its members the nearest suffix to the left in a lower group, and
moves these suffixes into groups right above their old ones, by how often they were found. When the last group is taken, a group's common
prefix is the longest Lyndon word that begins at its members: the Lyndon array. By the runs
theorem every run has a root in the Lyndon array of the order or of the reversed order, so
each root is extended both ways by longest common extensions, and what is long enough is a
run.

Only words inside a window of eight that occurs twice in the text can belong to a run, so
the sorter gets these stretches alone, with a separator of its own after each one. Nothing
else is left out: a run of ``min_length`` words and ``min_periods`` periods has every word in
such a window.

Each text is handled inside its row, so hot ids, sources or copies need no care, and a lost
executor repeats only its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import quoted
from tessella.llm.ragged import mix

MIN_LENGTH, MIN_PERIODS = 24, 3
# Words of a window that tells stretches which repeat.
WINDOW = 8
# Bytes of text that a task works on at once; a longer text is a group of its own.
GROUP_BYTES = 1 << 20


def lyndon_array(symbols: Sequence[int], descending: bool = False) -> np.ndarray:
    """Length of the longest Lyndon word that begins at each position.

    ``descending`` reverses the order of the symbols; the end counts as lowest both times.
    """
    n = len(symbols)
    alike: dict[int, list[int]] = {}
    for i, symbol in enumerate(symbols):
        if symbol in alike:
            alike[symbol].append(i)
        else:
            alike[symbol] = [i]
    members = [alike[s] for s in sorted(alike, reverse=descending)]
    length = [1] * len(members)
    size = [len(m) for m in members]
    lower = list(range(-1, len(members) - 1))
    upper = list(range(1, len(members) + 1))
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    taken = bytearray(n)
    left = list(range(-1, n - 1))
    found = [0] * n
    top = len(members) - 1
    while top >= 0:
        if size[top]:
            span = length[top]
            own = members[top] if size[top] == len(members[top]) else [i for i in members[top] if group[i] == top]
            for i in own:
                taken[i] = 1
                found[i] = span
            times: dict[int, int] = {}
            for i in own:
                j = left[i]
                while j >= 0 and taken[j]:
                    k = left[j]
                    if k >= 0 and taken[k]:
                        left[j] = k = left[k]
                    j = k
                left[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for j, n_times in times.items():
                moved.setdefault((group[j], n_times), []).append(j)
            for old, n_times in sorted(moved, reverse=True):
                leaving = moved[old, n_times]
                if len(leaving) == size[old]:
                    length[old] += n_times * span
                    continue
                new = len(members)
                members.append(leaving)
                size.append(len(leaving))
                size[old] -= len(leaving)
                length.append(length[old] + n_times * span)
                above = upper[old]
                lower.append(old)
                upper.append(above)
                lower[above] = upper[old] = new
                for j in leaving:
                    group[j] = new
        top = lower[top]
    return np.array(found, np.int64)


class Extensions:
    """Longest common extensions, by names of all spans whose length is a power of two."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.names = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
        span = 1
        while 2 * span <= self.n:
            last = self.names[-1].astype(np.int64)
            kinds, names = np.unique(last[: self.n - 2 * span + 1] * self.n + last[span : self.n - span + 1], return_inverse=True)
            if len(kinds) == len(names):
                break
            self.names.append(names.astype(np.int32))
            span *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of what begins at ``a`` and at ``b``; ``b`` is the later one."""
        far = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names, span = self.names[level], 1 << level
            at = np.flatnonzero(b + far + span <= self.n)
            same = at[names[a[at] + far[at]] == names[b[at] + far[at]]]
            far[same] += span
        return far

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of what ends before ``a`` and before ``b``."""
        far = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names, span = self.names[level], 1 << level
            at = np.flatnonzero(a - far - span >= 0)
            same = at[names[a[at] - far[at] - span] == names[b[at] - far[at] - span]]
            far[same] += span
        return far


def runs_of(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """(start, length, period) of each run, by start, then period."""
    if not len(symbols):
        return np.empty((0, 3), np.int64)
    plain = symbols.tolist()
    extensions = Extensions(symbols)
    found = []
    for descending in (False, True):
        roots = lyndon_array(plain, descending)
        at = np.flatnonzero(roots * min_periods <= len(symbols))
        period = roots[at]
        start = at - extensions.backward(at, at + period)
        length = at + period + extensions.forward(at, at + period) - start
        long = length >= np.maximum(min_length, min_periods * period)
        found.append(np.stack([start[long], period[long], length[long]], 1))
    every = np.unique(np.concatenate(found), axis=0)
    return every[:, [0, 2, 1]]


def stretches(symbols: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """(first, end) of the stretches of words inside windows that their text holds twice."""
    n = len(symbols)
    if n < window:
        return np.empty((0, 2), np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    key = mix(text[at].astype(np.uint64))
    for i in range(window):
        key = mix(key * np.uint64(3) + symbols[at + i].astype(np.uint64))
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at[again], 1)
    np.add.at(edges, at[again] + window, -1)
    inside = np.cumsum(edges[:n]) > 0
    begins = inside & np.r_[True, ~inside[:-1] | (text[1:] != text[:-1])]
    ends = inside & np.r_[~inside[1:] | (text[1:] != text[:-1]), True]
    return np.stack([np.flatnonzero(begins), np.flatnonzero(ends) + 1], 1)


def runs_in_texts(
    words: list[list[bytes]], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS
) -> list[np.ndarray]:
    """Runs of each text, with word numbers from 0."""
    number = count()
    known: dict[bytes, int] = {}
    for own in words:
        for w in own:
            if w not in known:
                known[w] = next(number)
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(own) for own in words], out=offsets[1:])
    symbols = np.fromiter((known[w] for own in words for w in own), np.int64, offsets[-1])
    # The widest window that every word of the shortest run of any period still shares with a
    # copy one period away: two periods and the window, less one word, fit into the run.
    slack = min(max(min_length, min_periods * q) - 2 * q for q in range(1, min_length // min_periods + 2))
    window = min(WINDOW, slack + 1)
    spans = stretches(symbols, offsets, window)
    spans = spans[spans[:, 1] - spans[:, 0] >= min_length]
    found: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(words)
    if not len(spans):
        return found
    parts, starts, at = [], [], 0
    for k, (first, end) in enumerate(spans):
        parts += [symbols[first:end], np.array([len(known) + k])]
        starts.append(at)
        at += end - first + 1
    runs = runs_of(np.concatenate(parts), min_length, min_periods)
    span = np.searchsorted(starts, runs[:, 0], "right") - 1
    at = runs[:, 0] - np.array(starts)[span] + spans[span, 0]
    text = np.searchsorted(offsets, at, "right") - 1
    own = np.stack([at - offsets[text], runs[:, 1], runs[:, 2]], 1)
    cuts = np.flatnonzero(np.diff(text)) + 1
    for t, rows in zip(text[np.r_[0, cuts]] if len(text) else [], np.split(own, cuts)):
        found[t] = rows
    return found


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that repeat a run's first period."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [w for w, over in zip(words, np.cumsum(edges[:-1]).tolist()) if not over]


def find_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_length: int = MIN_LENGTH,
    min_periods: int = MIN_PERIODS,
) -> DataFrame:
    """Runs of words in each text, and the text without their repeats.

    Words are what stands between space, tab, newline, vertical tab, form feed and carriage
    return. A run is a stretch of at least ``min_length`` words and ``min_periods`` of its
    smallest period that no neighbouring word extends. Returns the id, ``n_words``, ``runs``
    (start, length and period, by start, then period) and ``collapsed``: the words, joined by
    one space, without those that any run holds after its first period.

    One row per row, repeated and NULL ids included. NULL, empty and wordless texts have no
    words, no runs and an empty ``collapsed``. Long texts are taken whole. Other columns are
    not read, whatever their names.
    """
    if min_periods < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    kind = dict(docs.dtypes)[id_column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            first = held = 0
            for i in range(len(texts) + 1):
                size = len(texts[i] or b"") + 64 if i < len(texts) else 0
                if i > first and (i == len(texts) or held + size > GROUP_BYTES):
                    words = [(t or b"").split() for t in texts[first:i]]
                    runs = runs_in_texts(words, min_length, min_periods)
                    yield result(batch.column(0).slice(first, i - first), words, runs)
                    first, held = i, 0
                held += size

    def result(ids: pa.Array, words: list[list[bytes]], runs: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.zeros(len(runs) + 1, np.int32)
        np.cumsum([len(r) for r in runs], out=offsets[1:])
        flat = np.concatenate(runs)
        rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], ["start", "length", "period"])
        collapsed = pa.array([b" ".join(kept_words(w, r)) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, rows), collapsed],
            ["id", "n_words", "runs", "collapsed"],
        )

    found = docs.select(quoted(id_column).alias("id"), quoted(text_column).cast("string").alias("text")).mapInArrow(
        work, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
    return found.withColumnRenamed("id", id_column)


def with_planted_periods(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and text, where a tenth of the ids gets a periodic tail.

    With h the CRC-32 of the decimal id, h % 10 = 0 and n words, word i from a = (h div 10) % n
    on becomes word a + (i - a) % p with p = 1 + (n - a) div (3 + h div 10 % 8). Rows of NULL
    ids and texts without words stay as they are.
    """
    h = F.crc32(quoted(id_column).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(quoted(text_column), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    some = docs.select(
        quoted(id_column).alias("id"), quoted(text_column).cast("string").alias("body"), g.alias("g"),
        F.when(h % 10 == 0, words).alias("words"),
    )
    n = F.size("words")
    placed = some.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    index = lambda i: F.col("a") + (i - F.col("a")) % F.col("p")
    tail = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", index(i).cast("int"))))
    text = F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("body"))
    return placed.select(F.col("id").alias(id_column), text.alias(text_column))


def run_digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per text: number of runs, the run of most periods (ties: first start, then period) and
    SHA-256 digests of all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    more = lambda a, b: b.isNull() | (a["length"] * b["period"] > b["length"] * a["period"])
    best = F.aggregate("runs", none, lambda b, r: F.when(more(r, b), r).otherwise(b))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("best", best).select(
        quoted(id_column),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        sha(lines).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
        "n_words",
    )
