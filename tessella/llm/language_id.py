"""Language of a text by cross-parsing entropy.

A suffix automaton of labelled text per language gives, from any place of a text, the
longest match that the language has shown. Cutting a text greedily into such phrases
counts how well the language explains it; the language needing the fewest phrases per
symbol, normalised by the size of its sample, wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import ragged
from tessella.llm.common import fold, quoted

# Bounds of the learning sample: rows and characters of each language, and the bytes
# that all transition tables may fill together.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 40_000
WINDOW_CHARS = 400
MAX_SYMBOLS = 250
TABLE_BYTES = 160_000_000
BLOCK = 512
UNDETERMINED = "und"


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring; state 0 starts."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p >= 0:
            q = step[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(s) == q:
                    step[p][s] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts with one 0 for each run of anything else, and offsets.

    A 0 at the start or the end of a text is left out, so a text without letters is empty.
    """
    codes, offsets = ragged.flatten([t.lower() for t in texts])
    letter = ragged.general_classes()[codes] == 1
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter
    keep[offsets[1:-1][offsets[1:-1] < len(codes)]] &= letter[offsets[1:-1][offsets[1:-1] < len(codes)]]
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=ends[1:])
    bounds = ends[offsets]
    out = np.where(letter, codes, 0)[keep]
    trailing = np.zeros(len(out), bool)
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    trailing[last] = out[last] == 0
    shift = np.zeros(len(out) + 1, np.int64)
    np.cumsum(trailing, out=shift[1:])
    return out[~trailing], bounds - shift[bounds]


@dataclass
class CrossParser:
    """Dense transition tables of all languages over one alphabet.

    ``tables[l][state + symbol]`` holds the next state times the width of the alphabet;
    where the language knows no longer match it holds the complement of the state that
    the symbol alone leads to, which also marks the end of a phrase.
    """

    languages: list[str]
    letters: np.ndarray  # sorted code points; place + 1 is the symbol
    tables: list[np.ndarray]
    sizes: list[int]

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> CrossParser:
        languages = sorted(samples)
        texts = {}
        for name in languages:
            codes, offsets = normalised(samples[name])
            parts = [codes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b > a]
            if parts:
                texts[name] = np.concatenate([np.append(p, 0) for p in parts])
        languages = sorted(texts)
        if not languages:
            return cls([], np.zeros(0, np.uint32), [], [])
        values, counts = np.unique(np.concatenate(list(texts.values())), return_counts=True)
        values, counts = values[values > 0], counts[values > 0]
        common = np.lexsort((values, -counts))[:MAX_SYMBOLS]
        letters = np.sort(values[common]).astype(np.uint32)
        parser = cls(languages, letters, [], [])
        width = parser.width
        most = max(1000, TABLE_BYTES // (8 * width * len(languages)))
        for name in languages:
            symbols = parser.symbols(texts[name])[:most]
            steps = suffix_automaton(symbols.tolist())
            miss = np.full(width, ~0, np.int32)
            for s, to in steps[0].items():
                miss[s] = ~(to * width)
            table = np.tile(miss, (len(steps), 1))
            for state, row in enumerate(steps):
                for s, to in row.items():
                    table[state, s] = to * width
            parser.tables.append(table.ravel())
            parser.sizes.append(len(symbols))
        return parser

    @property
    def width(self) -> int:
        return len(self.letters) + 2

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """0 for a gap, 1.. for known letters, the last for all others."""
        if not len(self.letters):
            return np.where(codes == 0, 0, 1).astype(np.int32)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        known = self.letters[at] == codes
        return np.where(codes == 0, 0, np.where(known, at + 1, self.width - 1)).astype(np.int32)

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases per text and language. Phrases end at the edges of blocks of ``BLOCK``
        symbols, so that blocks of all texts are parsed side by side."""
        lengths = np.diff(offsets)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(lengths)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = offsets[:-1][owner] + number * BLOCK
        size = np.minimum(offsets[1:][owner] - begin, BLOCK)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        alive = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks longer than t
        found = np.zeros((len(lengths), len(self.languages)), np.int64)
        states = [np.zeros(len(owner), np.int32) for _ in self.languages]
        counts = [np.zeros(len(owner), np.int32) for _ in self.languages]
        for t in range(int(size[0]) if len(size) else 0):
            n = alive[t]
            now = symbols[begin[:n] + t]
            for table, state, count in zip(self.tables, states, counts, strict=True):
                value = table[state[:n] + now]
                ended = value >> 31
                count[:n] -= ended
                state[:n] = value ^ ended
        for i, (state, count) in enumerate(zip(states, counts, strict=True)):
            found[:, i] = ragged.sums(count + (state > 0), owner, len(lengths))
        return found

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol of each text under each language, and symbols per text."""
        bits = np.zeros((len(texts), len(self.languages)))
        size = np.zeros(len(texts), np.int64)
        scale = np.log2(np.array(self.sizes, float) + 1)
        for first, group in ragged.groups(texts):
            codes, offsets = normalised(group)
            lengths = np.diff(offsets)
            size[first : first + len(group)] = lengths
            if len(codes) and self.languages:
                found = self.phrases(self.symbols(codes), offsets)
                bits[first : first + len(group)] = found * scale / np.maximum(lengths, 1)[:, None]
        return bits, size

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        bits, size = self.entropies(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        if len(self.languages) > 1:
            second = np.partition(bits, 1, axis=1)[:, 1]
            score = second / np.maximum(low + second, 1e-300)
        else:
            score = np.ones(len(texts))
        names = [self.languages[b] if n else UNDETERMINED for b, n in zip(best, size, strict=True)]
        return names, np.where(size > 0, score, 0.0)


def learning_sample(
    df: DataFrame,
    learn: Column,
    id_column: str,
    text_column: str,
    lang_column: str,
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
) -> dict[str, list[str]]:
    """A bounded sample of windows of labelled text per language.

    About ``rows`` rows of each language are drawn by hash; windows of all places of
    these texts, again by hash, fill up to ``chars`` characters. What reaches the driver
    is at most ``chars`` characters per language.
    """
    labelled = df.where(learn & quoted(lang_column).isNotNull() & quoted(text_column).isNotNull()).select(
        quoted(lang_column).alias("lang"),
        quoted(text_column).alias("text"),
        F.xxhash64(quoted(id_column), F.xxhash64(quoted(text_column))).bitwiseAND(2**63 - 1).alias("draw"),
    )
    totals = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    drawn = labelled.join(F.broadcast(totals), "lang").where(
        F.col("draw") / F.lit(float(2**63)) <= F.lit(float(rows)) / F.col("n")
    )
    place = F.explode(F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1)), F.lit(WINDOW_CHARS)))
    windows = (
        drawn.select("lang", "text", place.alias("place"))
        .select("lang", F.expr(f"substring(text, place, {WINDOW_CHARS})").alias("part"))
        .distinct()
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("part"), "part")
    kept = windows.withColumn("_rank", F.row_number().over(order)).where(
        F.col("_rank") <= -(-chars // WINDOW_CHARS)
    )
    out: dict[str, list[str]] = {}
    for row in kept.orderBy("lang", "_rank").select("lang", "part").collect():
        out.setdefault(row["lang"], []).append(row["part"])
    return out


def predicted(df: DataFrame, parser: CrossParser, text: Column) -> Column:
    """Struct (lang_pred, score) of a text column."""
    shared = df.sparkSession.sparkContext.broadcast(parser)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = shared.value.predict(batch.fillna("").tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text)


def identify_languages(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    modulus: int = 4,
    held_out_remainder: int = 2,
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score (0 to 1, 0.5 a tie).

    Learns only from rows with text and language outside the held-out fold. A NULL text
    and one without a letter are ``und`` with score 0, and so is every row when nothing
    could be learned. A row with a NULL id is neither learned from nor held out. Ties go
    to the alphabetically first language; copies get equal predictions. Texts are parsed
    whole. Other columns are not read.
    """
    part = fold(id_column, modulus)
    sample = learning_sample(df, part != held_out_remainder, id_column, text_column, lang_column)
    scored = df.select(
        quoted(id_column).alias(id_column),
        F.coalesce(part == held_out_remainder, F.lit(False)).alias("held_out"),
        predicted(df, CrossParser.fit(sample), quoted(text_column)).alias("_p"),
    )
    return scored.select(id_column, "held_out", F.col("_p.lang_pred"), F.col("_p.score"))
