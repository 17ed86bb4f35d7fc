"""Token counts by rank-synchronous merging of ragged arrays.

All pre-tokens of a group of texts lie in one flat symbol array. In each round every
pre-token applies its own lowest-rank pair, all of them at once; rounds end when no
pre-token has a mergeable pair. Only distinct pre-tokens are merged, and a bounded
cache per worker keeps counts that earlier groups found.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import ragged
from tessella.llm.common import quoted

# Fixed values of the vocabulary file's pre-tokeniser: white space and contractions.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 0
NO_RANK = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class RankMerger:
    """A word-end byte-pair vocabulary as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.size = len(vocab)
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        classes = ragged.general_classes().copy()
        classes[classes == 0] = OTHER
        classes[list(WHITE_SPACE)] = SPACE
        self.classes = classes
        self.cache = ragged.SpanCache()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count_words(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Symbols left of each word of UTF-8 bytes when no pair can merge any more."""
        lengths = np.diff(offsets)
        symbols = self.inner[data]
        symbols[offsets[1:] - 1] = self.final[data[offsets[1:] - 1]]
        counts = lengths.astype(np.int32)
        words = np.arange(len(lengths))
        active = lengths > 1
        symbols, words, lengths = symbols[np.repeat(active, lengths)], words[active], lengths[active]
        while len(words):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            rank = np.full(len(symbols), NO_RANK, np.int32)
            rank[:-1] = self.rank_of(symbols[:-1], symbols[1:])
            rank[ends - 1] = NO_RANK  # no pair reaches over the end of a word
            lowest = np.minimum.reduceat(rank, starts)
            here = (rank == np.repeat(lowest, lengths)) & (rank != NO_RANK)
            # of touching equal pairs (aaa) take the first, third, ... of each run
            place = np.arange(len(symbols))
            first = here.copy()
            first[1:] &= ~here[:-1]
            run_start = np.maximum.accumulate(np.where(first, place, 0))
            here &= (place - run_start) % 2 == 0
            at = np.flatnonzero(here)
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            lengths = np.add.reduceat(keep, starts, dtype=np.int64)
            counts[words] = lengths
            going = (lowest != NO_RANK) & (lengths > 1)
            symbols = symbols[keep]
            symbols = symbols[np.repeat(going, lengths)]
            words, lengths = words[going], lengths[going]
        return counts

    def spans(self, codes: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens: letter runs, single numbers, runs of anything else but white space."""
        kind = self.classes[codes]
        changed = np.ones(len(codes), bool)
        changed[1:] = (kind[1:] != kind[:-1]) | new[1:] | (kind[1:] == NUMBER)
        cut = changed.copy()
        for at in np.flatnonzero((codes == ord("'")) & changed):
            # a contraction counts only where a token starts at its apostrophe
            for word in CONTRACTIONS:
                end = at + len(word)
                if end <= len(codes) and not new[at + 1 : end].any() and all(
                    codes[at + i] == ord(c) for i, c in enumerate(word)
                ):
                    cut[at + 1 : end] = False
                    if end < len(codes):
                        cut[end] = True
                    break
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(codes))
        solid = kind[starts] != SPACE
        return starts[solid], ends[solid]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        for first, group in ragged.groups(texts):
            plain = []
            for i, text in enumerate(group):
                if "<" in text:
                    for token in self.special:
                        total[first + i] += text.count(token)
                        text = text.replace(token, "\n")  # parts stay apart
                # single characters are lowered, so no sigma becomes a final one
                plain.append(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
            codes, offsets = ragged.flatten(plain)
            if not len(codes):
                continue
            starts, ends = self.spans(codes, ragged.breaks(len(codes), offsets))
            if not len(starts):
                continue
            hashes = ragged.span_hashes(codes, starts, ends)
            distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)

            def merged(missing: np.ndarray) -> np.ndarray:
                if not len(missing):
                    return np.zeros(0, np.int32)
                part, word_offsets = ragged.gather(codes, starts[at[missing]], ends[at[missing]])
                width = 1 + (part > 0x7F) + (part > 0x7FF).astype(np.int64) + (part > 0xFFFF)
                byte_ends = np.concatenate([[0], np.cumsum(width)])
                data = np.frombuffer(ragged.text_of(part).encode("utf-8"), np.uint8)
                return self.count_words(data, byte_ends[word_offsets])

            per_word = self.cache.values_for(distinct, merged)
            owner = np.searchsorted(offsets, starts, side="right") - 1
            total[first : first + len(group)] += ragged.sums(per_word[inverse], owner, len(group)).astype(np.int64)
        return total


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text column as the tokenizers library counts them with the file at
    ``path`` (lower-casing byte-pair vocabulary with word ends), without added tokens.

    Special strings inside a text count one token each. NULL and empty texts have 0.
    The file must exist on every worker.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = merger(path)
        for batch in batches:
            yield pd.Series(model.counts(batch.fillna("").tolist()))

    return count(text)


def count_tokens(
    df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048
) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit.

    A NULL text counts as empty. Repeated rows and NULL ids stay as rows of their own;
    an empty table gives an empty one; other columns are not read. Texts are counted
    whole, however long.
    """
    text = F.coalesce(quoted(text_column), F.lit(""))
    counted = df.select(
        quoted(id_column).alias(id_column),
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(quoted(text_column), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
