"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Each class has its own discounted counts for the longer letter sequences; both back off
to the same continuation counts, gathered from both classes, so an expression too rare
for its class costs the two models alike. The difference of the two log-likelihoods per
letter is turned into a probability on labelled texts that the counts have not seen.

All sequences count, however many there are. A table of at most BROADCAST_SEQUENCES is
fitted on the driver and sent to the tasks; a larger one is made by aggregations, and the
distinct words of the corpus are scored by joins with it. Both plans give equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import ragged
from tessella.llm.common import fold, fresh, quoted
from tessella.scale import cut, is_small, skew_join, small_side

ORDER = 5
SHARED_ORDER = 2
DISCOUNT = 0.75
# Sequences that are fitted on the driver and broadcast; more are joined. No result depends on it.
BROADCAST_SEQUENCES = 600_000
# One labelled text in so many calibrates instead of being counted.
CALIBRATION_SHARE = 4
# Nats by which the likelihoods of a word may differ by chance; they count as equal.
NOISE = 2.5
BIN = 1 / 512
START, END = 0x110000, 0x110001
_BASE = 0x9E3779B97F4A7C15 | 1


def distinct_words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Letter runs, lower-cased: codes, starts, ends of distinct words, their sorted
    hashes, and per word of the texts its distinct word and its text."""
    codes, offsets = ragged.flatten([t.lower() for t in texts])
    letter = ragged.general_classes()[codes] == 1
    starts, ends = ragged.runs(letter, ragged.breaks(len(codes), offsets))
    hashes, at, inverse = np.unique(
        ragged.span_hashes(codes, starts, ends), return_index=True, return_inverse=True
    )
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return codes, starts[at], ends[at], hashes, inverse, owner


def sequences(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the sequences of 0..ORDER symbols that end at each symbol of the words
    (start marks before them, one end mark after), one row per symbol that is predicted or
    a last start mark; and the word of each row."""
    lengths = ends - starts
    padded = lengths + ORDER + 1
    offsets = np.concatenate([[0], np.cumsum(padded)])
    flat = np.full(offsets[-1], START, np.uint64)
    items, _ = ragged.gather(codes, starts, ends)
    word = np.repeat(np.arange(len(starts)), lengths)
    inner = np.arange(len(items)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[offsets[:-1][word] + ORDER + inner] = items
    flat[offsets[1:] - 1] = END
    rows = np.arange(len(flat)) - np.repeat(offsets[:-1], padded) >= ORDER - 1
    out = [np.zeros(int(rows.sum()), np.uint64)]
    raw = np.zeros(len(flat), np.uint64)
    for n in range(1, ORDER + 1):
        shifted = np.zeros(len(flat), np.uint64)
        shifted[n - 1 :] = flat[: len(flat) - n + 1]
        raw = raw + (shifted + np.uint64(1)) * np.uint64(pow(_BASE, n, 1 << 64))
        out.append(ragged.mix(raw + np.uint64(n))[rows])
    return out, np.repeat(np.arange(len(starts)), padded)[rows]


def sequence_counts(batch: pd.DataFrame) -> pd.DataFrame:
    """Sequence counts by class of labelled texts (text, toxic): one row per sequence with
    the hashes of its context and its suffix."""
    parts = []
    toxic = batch["toxic"].to_numpy()
    for first, group in ragged.groups(batch["text"].tolist()):
        codes, starts, ends, hashes, inverse, owner = distinct_words(group)
        if not len(hashes):
            continue
        kind = toxic[first : first + len(group)][owner]
        weights = [np.bincount(inverse[kind == k], minlength=len(hashes)) for k in (1, 0)]
        levels, word = sequences(codes, starts, ends)
        predicted = np.ones(len(word), bool)
        predicted[np.flatnonzero(np.diff(word, prepend=-1))] = False  # the last start mark
        at = np.flatnonzero(predicted)
        for n in range(1, ORDER + 1):
            keys, where, back = np.unique(levels[n][at], return_index=True, return_inverse=True)
            place = at[where]
            parts.append(
                pd.DataFrame(
                    {
                        "n": np.full(len(keys), n, np.int32),
                        "h": keys.view(np.int64),
                        "context": levels[n - 1][place - 1].view(np.int64),
                        "suffix": levels[n - 1][place].view(np.int64),
                        "toxic": np.bincount(back, weights[0][word[at]]).astype(np.int64),
                        "ordinary": np.bincount(back, weights[1][word[at]]).astype(np.int64),
                    }
                )
            )
    if not parts:
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("n", "h", "context", "suffix", "toxic", "ordinary")})
    return pd.concat(parts)


KINDS = ("toxic", "ordinary")
COUNTS_SCHEMA = "n int, h long, context long, suffix long, toxic long, ordinary long"


@dataclass
class ClassModels:
    """Interpolated models of both classes: sorted hashes with the discounted share of each
    sequence and the backoff weight of each context, columns toxic and ordinary."""

    keys: np.ndarray
    share: np.ndarray
    backoff: np.ndarray
    alphabet: int
    bias: float = 0.0
    slope: float = 0.0
    index: ragged.HashIndex | None = None

    @classmethod
    def fit(cls, counts: pd.DataFrame) -> ClassModels:
        n, h = counts["n"].to_numpy(), counts["h"].to_numpy().view(np.uint64)
        context, suffix = (counts[c].to_numpy().view(np.uint64) for c in ("context", "suffix"))
        raw = counts[["toxic", "ordinary"]].to_numpy(float)
        raw = np.where((n <= SHARED_ORDER)[:, None], raw.sum(axis=1, keepdims=True), raw)
        order = np.argsort(h)
        n, h, context, suffix, raw = n[order], h[order], context[order], suffix[order], raw[order]
        # shorter sequences count the distinct symbols seen before them
        used = raw.copy()
        at = np.minimum(np.searchsorted(h, suffix), max(len(h) - 1, 0))
        longer = (n > 1) & (h[at] == suffix) if len(h) else np.zeros(0, bool)
        before = np.zeros_like(raw)
        shared_target = n[at] <= SHARED_ORDER if len(h) else longer
        seen = (raw > 0).astype(float)
        seen = np.where(shared_target[:, None], seen.max(axis=1, keepdims=True), seen)
        np.add.at(before, at[longer], seen[longer])
        # at a word's start every sequence has the same symbol before it: keep its count
        inner = (n < ORDER)[:, None] & (before > 1)
        used[inner] = before[inner]
        keys, first = np.unique(np.concatenate([h, context]), return_index=True)
        total, kinds = np.zeros((len(keys), 2)), np.zeros((len(keys), 2))
        slot = np.searchsorted(keys, context)
        np.add.at(total, slot, used)
        np.add.at(kinds, slot, used > 0)
        share = np.zeros((len(keys), 2), np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            share[np.searchsorted(keys, h)] = np.nan_to_num(
                np.maximum(used - DISCOUNT, 0) / total[slot]
            )
            held = np.minimum(used, DISCOUNT)
            freed = np.zeros((len(keys), 2))
            np.add.at(freed, slot, held)
            backoff = np.where(total > 0, freed / total, 1.0).astype(np.float32)
        return cls(keys, share, backoff, int((n == 1).sum()) + 1)

    def word_differences(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word, less the noise."""
        if not len(self.keys) or not len(starts):
            return np.zeros(len(starts))
        if self.index is None:
            self.index = ragged.HashIndex(self.keys)
        levels, word = sequences(codes, starts, ends)
        predicted = np.ones(len(word), bool)
        predicted[np.flatnonzero(np.diff(word, prepend=-1))] = False
        at = np.flatnonzero(predicted)
        likelihood = np.full((len(at), 2), 1.0 / self.alphabet)
        hit, place = self.index.find(levels[0])
        for n in range(1, ORDER + 1):
            before = at - 1
            likelihood *= np.where(hit[before, None], self.backoff[place[before]], 1.0)
            hit, place = self.index.find(levels[n])
            likelihood += np.where(hit[at, None], self.share[place[at]], 0.0)
        difference = np.log(likelihood[:, 0]) - np.log(likelihood[:, 1])
        total = ragged.sums(difference, word[at], len(starts))
        return np.sign(total) * np.maximum(np.abs(total) - NOISE, 0)

    def margins(self, texts: list[str], cache: ragged.SpanCache) -> np.ndarray:
        """Difference of the log-likelihoods per predicted symbol of each text."""
        out = np.zeros(len(texts))
        for first, group in ragged.groups(texts):
            codes, starts, ends, hashes, inverse, owner = distinct_words(group)
            if not len(hashes):
                continue
            values = cache.values_for(
                hashes, lambda missing: self.word_differences(codes, starts[missing], ends[missing])
            )
            size = (ends - starts + 1)[inverse]
            total = ragged.sums(size, owner, len(group))
            out[first : first + len(group)] = ragged.sums(values[inverse], owner, len(group)) / np.maximum(total, 1)
        return out

    def calibrate(self, bins: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> None:
        """Logistic curve over binned margins by Newton steps, slightly damped."""
        x = np.concatenate([bins, bins]) * BIN
        y = np.concatenate([np.ones(len(bins)), np.zeros(len(bins))])
        weight = np.concatenate([toxic, ordinary]).astype(float)
        self.bias = self.slope = 0.0
        if not len(bins):
            return
        design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
        ridge = np.diag([1e-2, 1e-4])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
            gradient = design.T @ (weight * (y - p)) - ridge @ beta
            hessian = design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge
            step = np.linalg.solve(hessian, gradient)
            beta += step * min(1.0, 4.0 / max(np.abs(step[0]), np.abs(step[1]) / 50, 1e-9))
            if np.abs(step).max() < 1e-9:
                break
        self.bias, self.slope = float(beta[0]), float(beta[1])

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * margins, -35, 35)))


_caches: dict[str, ragged.SpanCache] = {}


def _cache(key: str) -> ragged.SpanCache:
    if key not in _caches:
        _caches.clear()  # one model at a time
        _caches[key] = ragged.SpanCache()
    return _caches[key]


def scored(df: DataFrame, model: ClassModels, text: Column, raw: bool = False) -> Column:
    """Score (or, with ``raw``, the margin) of a text column."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    key = f"{id(shared)}-{df.sparkSession.sparkContext.applicationId}-{shared._jbroadcast.id()}"

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, cache = shared.value, _cache(key)
        for batch in batches:
            margins = held.margins(batch.fillna("").tolist(), cache)
            yield pd.Series(margins if raw else held.scores(margins))
        ragged.give_back()

    return score(text)


def parted(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequence counts, and the texts that calibrate, of a table (text, toxic 0/1) without NULLs.

    One text in CALIBRATION_SHARE, drawn by a hash of the text so that copies stay on one
    side, calibrates; the sequences of all others are counted. No labelled text is left out.
    Counting is one aggregation over the labelled texts and grows with them.
    """
    side = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION_SHARE)) == 0
    sided = labelled.select("text", F.col("toxic").cast("int").alias("toxic"), side.alias("calibrates"))
    counted = sided.where(~F.col("calibrates"))
    counts = (
        counted.select("text", "toxic")
        .mapInPandas(lambda batches: map(sequence_counts, batches), COUNTS_SCHEMA)
        .groupBy("n", "h", "context", "suffix")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    )
    return cut(counts), sided.where("calibrates").select("text", "toxic")


def calibrated(model: ClassModels, margins: DataFrame) -> ClassModels:
    """``model`` with the curve of the rows (toxic, margin)."""
    bins = (
        margins.select("toxic", F.round(F.col("margin") / BIN).alias("bin"))
        .groupBy("bin")
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("ordinary"))
        .toPandas()
    )
    model.calibrate(bins["bin"].to_numpy(), bins["toxic"].to_numpy(), bins["ordinary"].to_numpy())
    return model


def model_table(counts: DataFrame) -> DataFrame:
    """What ``ClassModels.fit`` computes, as aggregations: key, share and backoff (s_*, b_*)
    of both classes for each sequence and context."""
    shared = F.col("n") <= SHARED_ORDER
    raw = counts.select(
        "n", "h", "context", "suffix",
        *[F.when(shared, F.col("toxic") + F.col("ordinary")).otherwise(F.col(k)).alias(k) for k in KINDS],
    )
    either = (F.col("toxic") > 0) | (F.col("ordinary") > 0)
    before = raw.where("n > 1").groupBy(F.col("suffix").alias("h")).agg(
        *[
            F.count_if(F.when(F.col("n") - 1 <= SHARED_ORDER, either).otherwise(F.col(k) > 0)).alias(f"before_{k}")
            for k in KINDS
        ]
    )
    used = raw.join(before, "h", "left").select(
        "h",
        "context",
        *[
            F.when((F.col("n") < ORDER) & (F.col(f"before_{k}") > 1), F.col(f"before_{k}"))
            .otherwise(F.col(k))
            .cast("double")
            .alias(k)
            for k in KINDS
        ],
    )
    totals = used.groupBy("context").agg(
        *[F.sum(k).alias(f"total_{k}") for k in KINDS],
        *[F.sum(F.least(F.col(k), F.lit(DISCOUNT))).alias(f"freed_{k}") for k in KINDS],
    )
    some = {k: F.col(f"total_{k}") > 0 for k in KINDS}
    shares = used.join(totals, "context").select(
        F.col("h").alias("key"),
        *[
            F.when(some[k], F.greatest(F.col(k) - DISCOUNT, F.lit(0.0)) / F.col(f"total_{k}")).alias(f"s_{k}")
            for k in KINDS
        ],
    )
    backoffs = totals.select(
        F.col("context").alias("key"),
        *[F.when(some[k], F.col(f"freed_{k}") / F.col(f"total_{k}")).alias(f"b_{k}") for k in KINDS],
    )
    # single precision, as in the arrays of ClassModels
    return shares.join(backoffs, "key", "full").select(
        "key",
        *[F.coalesce(f"s_{k}", F.lit(0.0)).cast("float").alias(f"s_{k}") for k in KINDS],
        *[F.coalesce(f"b_{k}", F.lit(1.0)).cast("float").alias(f"b_{k}") for k in KINDS],
    )


def words_of_texts(batch: pd.DataFrame) -> pd.DataFrame:
    """(t, u, size, w, times, word) for the distinct words of each text (text, t, u)."""
    parts = []
    for first, group in ragged.groups(batch["text"].tolist()):
        codes, starts, ends, hashes, inverse, owner = distinct_words(group)
        if not len(hashes):
            continue
        size = ragged.sums((ends - starts + 1)[inverse], owner, len(group))
        pairs, times = np.unique(owner * len(hashes) + inverse, return_counts=True)
        text, word = pairs // len(hashes), pairs % len(hashes)
        spelled = np.array(["".join(map(chr, codes[a:b])) for a, b in zip(starts, ends, strict=True)], object)
        here = batch.iloc[first : first + len(group)]
        parts.append(
            pd.DataFrame(
                {
                    "t": here["t"].to_numpy()[text],
                    "u": here["u"].to_numpy()[text],
                    "size": size[text].astype(np.int64),
                    "w": hashes.view(np.int64)[word],
                    "times": times.astype(np.int64),
                    "word": pd.Series(spelled[word], dtype=object),
                }
            )
        )
    return pd.concat(parts) if parts else pd.DataFrame(columns=["t", "u", "size", "w", "times", "word"], dtype=object)


def sequences_of_words(batch: pd.DataFrame) -> pd.DataFrame:
    """(w, pos, n, key) of distinct words (w, word); pos -1 is the last start mark."""
    parts = []
    for first, group in ragged.groups(batch["word"].tolist()):
        codes, offsets = ragged.flatten(group)
        levels, owner = sequences(codes, offsets[:-1], offsets[1:])
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        pos = np.arange(len(owner)) - begins[owner] - 1
        w = batch["w"].to_numpy()[first : first + len(group)][owner]
        for n in range(1, ORDER + 1):
            parts.append(pd.DataFrame({"w": w, "pos": pos, "n": n, "key": levels[n].view(np.int64)}))
    return pd.concat(parts) if parts else pd.DataFrame(columns=["w", "pos", "n", "key"], dtype=np.int64)


def joined_differences(words: DataFrame, table: DataFrame, alphabet: int) -> DataFrame:
    """(w, value): ``ClassModels.word_differences`` of distinct words (w, word) by a join of
    their sequences with the table of the models; words that count as equal are left out."""
    empty = table.where("key = 0").first()  # the context without symbols
    keys = cut(words.mapInPandas(lambda batches: map(sequences_of_words, batches), "w long, pos int, n int, key long"))
    found = skew_join(keys, table, ["key"], "left", spread_by=["w", "pos"])
    # a sequence gives its share where it ends and its backoff weight to the next symbol
    uses = F.array(
        F.struct(
            "pos", "n",
            *[F.coalesce(F.col(f"s_{k}").cast("double"), F.lit(0.0)).alias(f"s_{k}") for k in KINDS],
            *[F.lit(None).cast("double").alias(f"b_{k}") for k in KINDS],
        ),
        F.struct(
            (F.col("pos") + 1).alias("pos"), (F.col("n") + 1).alias("n"),
            *[F.lit(None).cast("double").alias(f"s_{k}") for k in KINDS],
            *[F.coalesce(F.col(f"b_{k}").cast("double"), F.lit(1.0)).alias(f"b_{k}") for k in KINDS],
        ),
    )
    symbols = found.select("w", F.inline(uses)).groupBy("w", "pos").agg(
        *[
            F.max(F.when(F.col("n") == n, F.col(f"{part}_{k}"))).alias(f"{part}{n}_{k}")
            for part in "sb"
            for n in range(1, ORDER + 1)
            for k in KINDS
        ]
    )
    logs = []
    for k in KINDS:
        p = F.lit(1.0 / alphabet) * F.lit(float(empty[f"b_{k}"]) if empty else 1.0) + F.col(f"s1_{k}")
        for n in range(2, ORDER + 1):
            p = p * F.col(f"b{n}_{k}") + F.col(f"s{n}_{k}")
        logs.append(F.log(p))
    # no share: beyond the end mark
    total = symbols.where("pos >= 0 and s1_toxic is not null").groupBy("w").agg(F.sum(logs[0] - logs[1]).alias("total"))
    value = F.signum("total") * (F.abs("total") - NOISE)
    return total.where(F.abs("total") > NOISE).select("w", value.alias("value"))


def joined_margins(texts: DataFrame, table: DataFrame, alphabet: int) -> DataFrame:
    """(t, u, margin) of the texts (text, t, u) whose margin is not 0; t and u, hashes of the
    text, name it. Copies are scored once."""
    listed = cut(
        texts.mapInPandas(
            lambda batches: map(words_of_texts, batches), "t long, u long, size long, w long, times long, word string"
        ).groupBy("t", "u", "w").agg(F.max("size").alias("size"), F.max("times").alias("times"), F.max("word").alias("word"))
    )
    words = listed.groupBy("w").agg(F.max("word").alias("word"))
    values = cut(joined_differences(words, table, alphabet))
    narrow = listed.drop("word")
    odd = narrow.join(F.broadcast(values), "w") if is_small(values) else skew_join(narrow, values, ["w"], spread_by=["t"])
    return odd.groupBy("t", "u").agg((F.sum(F.col("times") * F.col("value")) / F.max("size")).alias("margin"))


def with_scores(documents: DataFrame, labelled: DataFrame, name: str, text_column: str = "text") -> DataFrame:
    """``documents`` with the score of the text as column ``name``, learned from ``labelled``
    (text, toxic 0/1) without NULLs."""
    counts, calibrating = parted(labelled)
    text = quoted(text_column)
    if counts.count() <= BROADCAST_SEQUENCES:
        model = ClassModels.fit(counts.toPandas())
        margins = calibrating.select("toxic", scored(labelled, model, F.col("text"), raw=True).alias("margin"))
        return documents.withColumn(name, scored(documents, calibrated(model, margins), text))
    alphabet = counts.where("n = 1").count() + 1
    said = F.coalesce(text, F.lit(""))
    t, u = fresh(documents, "_t"), fresh(documents, "_u")
    named = documents.withColumns({t: F.xxhash64(said), u: F.xxhash64(said, F.lit("margin"))})
    learned = calibrating.withColumns({"t": F.xxhash64("text"), "u": F.xxhash64("text", F.lit("margin"))})
    texts = named.select(said.alias("text"), quoted(t).alias("t"), quoted(u).alias("u"))
    found = cut(joined_margins(texts.unionByName(learned.drop("toxic")), cut(model_table(counts)), alphabet))
    side = small_side(found)
    margins = learned.join(side, ["t", "u"], "left").select("toxic", F.coalesce("margin", F.lit(0.0)).alias("margin"))
    curve = calibrated(ClassModels.fit(counts.limit(0).toPandas()), margins)
    margin = fresh(documents, "_margin")
    side = side.select(F.col("t").alias(t), F.col("u").alias(u), F.col("margin").alias(margin))
    line = F.lit(curve.bias) + F.lit(curve.slope) * F.coalesce(quoted(margin), F.lit(0.0))
    score = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(35.0)), F.lit(-35.0))))
    return named.join(side, [t, u], "left").withColumn(name, score).drop(t, u, margin).select(*map(quoted, [*documents.columns, name]))


def labelled_texts(
    documents: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(text, toxic) of labelled documents; rows with a NULL text or label teach nothing."""
    marks = labels.where(F.col("toxic").isin(0, 1) & quoted(id_column).isNotNull()).groupBy(
        quoted(id_column).alias("_id")
    ).agg(F.max("toxic").alias("toxic"))
    texts = documents.where(learn & quoted(text_column).isNotNull()).select(
        quoted(id_column).alias("_id"), quoted(text_column).alias("text")
    )
    # ids and marks are narrow: broadcast once counted, so that texts stay where they are
    return texts.join(small_side(marks), "_id").select("text", "toxic")


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    modulus: int = 3,
    held_out_remainder: int = 1,
    threshold: float = 0.7,
) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Labels are learned only outside the held-out fold; a row with a NULL id is neither
    learned from nor held out. NULL texts and texts without letters get the score of a
    margin of 0; with nothing to learn from every score is 0.5. Several labels of one id
    count as toxic if one is. Copies get equal scores; texts are scored whole.
    """
    part = fold(id_column, modulus)
    labelled = labelled_texts(documents, labels, part != held_out_remainder, id_column, text_column)
    rows = documents.select(
        quoted(id_column).alias(id_column),
        F.coalesce(part == held_out_remainder, F.lit(False)).alias("held_out"),
        quoted(text_column).alias("_text"),
    )
    return (
        with_scores(rows, labelled, "score", "_text")
        .drop("_text")
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
