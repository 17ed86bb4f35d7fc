"""Column expressions over text: tokens, word sets, aspects and text scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import lexicon as lx

# Any Unicode blank, including the ASCII separators 0x1c-0x1f.
BLANK = r"(?U)[\s\x1c-\x1f]+"
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]+"
TOKEN = r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?"
WORD_RUN = r"(?U)\w+"
EDGE_BLANK = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
DEFINITION = r"(?U)(?:is|are|was|were|means|refers to|defined as) (\w+(?:\s+\w+){0,5})"
QUOTED = r'"([^"]+)"'


def strings(values) -> Column:
    """A constant array of strings."""
    return F.array(*[F.lit(v) for v in values])


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


def word_set(text: Column) -> Column:
    return F.array_distinct(lower_words(text))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_BLANK))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_BLANK, "")


def tokens(text: Column) -> Column:
    """Lower-case ASCII tokens, keeping an inner apostrophe."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def capitalised(text: Column) -> Column:
    """Whole words made of one ASCII capital followed by ASCII small letters."""
    return F.filter(
        F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0)),
        lambda w: w.rlike("^[A-Z][a-z]+$"),
    )


def _bigrams(toks: Column) -> Column:
    lead = F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0)))
    return F.transform(
        lead, lambda w, i: F.concat_ws(" ", w, F.get(toks, i + 1))
    )


def _long_query_aspects(query: Column, toks: Column) -> Column:
    stop = strings(lx.ASPECT_STOPWORDS)
    key_terms = F.filter(toks, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))
    parts = F.concat(
        F.regexp_extract_all(query, F.lit(QUOTED), F.lit(1)),
        capitalised(query),
        F.slice(key_terms, 1, 6),
    )
    return F.slice(F.array_distinct(parts), 1, 10)


def aspects(query: Column, min_aspects: int = 2) -> Column:
    """Ordered aspects of a query; short queries fall back to their halves."""
    return bind(lower_words(query), lambda toks: _aspects(query, toks, min_aspects))


def _aspects(query: Column, toks: Column, min_aspects: int) -> Column:
    singles = F.filter(toks, lambda t: F.length(t) > 2)
    short = F.concat(singles, _bigrams(toks))
    half = F.floor(F.length(query) / 2).cast("int")
    halves = F.array(
        F.substring(query, F.lit(1), half),
        F.substring(query, half + 1, F.length(query)),
    )
    short = F.when(
        (F.size(short) < min_aspects) & (F.length(query) > 2), F.concat(short, halves)
    ).otherwise(short)
    return F.when(
        F.size(toks) < 5, F.slice(F.array_distinct(short), 1, 5)
    ).otherwise(_long_query_aspects(query, toks))


def composition_aspects(query: Column) -> Column:
    """As :func:`aspects` without the halves; order is first appearance."""
    toks = lower_words(query)
    singles = F.filter(toks, lambda t: F.length(t) > 2)
    return F.when(
        F.size(toks) < 5, F.slice(F.array_distinct(F.concat(singles, _bigrams(toks))), 1, 5)
    ).otherwise(_long_query_aspects(query, toks))


def overlap_share(a: Column, b: Column) -> Column:
    """Shared words over the size of the smaller word set (0 when one is empty)."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)
    ).otherwise(F.lit(0.0))


def vagueness(text: Column) -> Column:
    def score(distinct: Column) -> Column:
        hedges = F.size(F.array_intersect(distinct, strings(lx.HEDGES)))
        return F.when(
            F.size(distinct) > 0, F.least(hedges / F.size(distinct) * 5.0, F.lit(1.0))
        ).otherwise(F.lit(0.0))

    return bind(word_set(text), score)


def negation_share(text: Column) -> Column:
    def score(toks: Column) -> Column:
        negative = F.size(F.filter(toks, lambda w: w.isin(list(lx.NEGATIONS))))
        return F.when(
            F.size(toks) > 0, F.least(negative / F.size(toks) * 3.0, F.lit(1.0))
        ).otherwise(F.lit(0.0))

    return bind(lower_words(text), score)


def antonyms_in(text: Column) -> Column:
    """The words of the antonym pairs that occur in ``text``: all of its words that
    ``antonym_sides`` looks for, so that those are few."""
    return F.array_intersect(F.split(F.lower(text), BLANK), strings([word for pair in lx.ANTONYMS for word in pair]))


def antonym_sides(word_array: Column, side: int) -> Column:
    """Indexes of the antonym pairs whose left (0) or right (1) word occurs."""
    sides = strings([pair[side] for pair in lx.ANTONYMS])

    def indexes(ws: Column) -> Column:
        return F.filter(
            F.transform(sides, lambda w, i: F.when(F.array_contains(ws, w), i)),
            lambda i: i.isNotNull(),
        )

    return bind(word_array, indexes)


def antonym_score(left_a: Column, right_a: Column, left_b: Column, right_b: Column) -> Column:
    """Contradiction score of two texts from their antonym indexes."""
    opposed = F.array_union(
        F.array_intersect(left_a, right_b), F.array_intersect(right_a, left_b)
    )
    return F.least(F.size(opposed) * F.lit(0.25), F.lit(0.8))


def text_antonym_score(a: Column, b: Column) -> Column:
    def sides(text: Column) -> Column:
        return bind(
            word_set(text),
            lambda ws: F.struct(antonym_sides(ws, 0).alias("left"), antonym_sides(ws, 1).alias("right")),
        )

    return bind(
        F.struct(sides(a).alias("a"), sides(b).alias("b")),
        lambda s: antonym_score(s["a"]["left"], s["a"]["right"], s["b"]["left"], s["b"]["right"]),
    )


def overlap_excerpt(a: Column, b: Column, limit: int = 100) -> Column:
    """Words of ``a`` that also occur in ``b``, cut to ``limit`` characters; the time is that of
    reading both texts once."""

    @F.pandas_udf("string")
    def excerpts(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_excerpt(x, y, limit) for x, y in zip(left, right, strict=True)], dtype=object)

    return excerpts(a, b)


def _excerpt(a: str | None, b: str | None, limit: int) -> str:
    if not a or not b:
        return ""
    return shared_words(a.split(), set(b.split()), limit)  # blanks of ``split`` are those of BLANK


def shared_words(words: list[str], known: set[str], limit: int) -> str:
    """Those of ``words`` that are ``known``, cut to ``limit`` characters."""
    if len(words) <= limit // 4:
        shared = [word for word in words if word in known]
    else:
        shared, size = [], -1
        for word in words:
            if size > limit:
                break
            if word in known:
                shared.append(word)
                size += len(word) + 1
    joined = " ".join(shared)
    cut = joined[:limit] + "..." if len(joined) > limit else joined
    return cut if len(cut) > 10 else ""


def definitions(text: Column) -> Column:
    """First three phrases that follow a defining verb."""
    return F.transform(
        F.slice(F.regexp_extract_all(text, F.lit(DEFINITION), F.lit(1)), 1, 3), strip
    )


def lead_phrases(text: Column) -> Column:
    """First six words of each of the first five sentences longer than ten characters."""
    sentences = F.slice(F.split(text, "[.!?]+"), 1, 5)
    kept = F.filter(F.transform(sentences, strip), lambda s: F.length(s) > 10)
    return F.transform(kept, lambda s: F.array_join(F.slice(words(s), 1, 6), " "))


def looks_like_code(text: Column) -> Column:
    hits = sum(
        (F.expr("0") + text.rlike("(?m)" + marker).cast("int") for marker in lx.CODE_MARKERS),
        F.lit(0),
    )
    return hits >= 3


def phrases(text: Column, min_words: int = 10, max_words: int = 50) -> Column:
    """Reusable sentences of a text, in order."""
    flat = strip(F.regexp_replace(text, BLANK, " "))
    sentences = F.transform(F.split(flat, "[.!?]+"), strip)
    stop = list(lx.PHRASE_STOPWORDS)

    def useful(sentence: Column) -> Column:
        return bind(words(sentence), lambda ws: F.size(ws).between(min_words, max_words)
                    & (F.size(F.filter(ws, lambda w: ~F.lower(w).isin(stop))) >= 3))

    return F.filter(sentences, useful)


def phrase_name(phrase: Column) -> Column:
    def name(ws: Column) -> Column:
        return F.concat(
            F.array_join(F.slice(ws, 1, 5), " "),
            F.when(F.size(ws) > 5, F.lit("...")).otherwise(F.lit("")),
        )

    return F.substring(bind(words(phrase), name), 1, 60)


LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def lines(text: Column) -> Column:
    """Lines of a text; a trailing break opens no further line."""
    def trimmed(parts: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).when(
            F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
        ).otherwise(parts)

    return bind(F.split(text, LINE_BREAK), trimmed)


def line_changes(new: Column, old: Column, limit: int = 50) -> Column:
    """Positional comparison of two line arrays: the first ``limit`` differing lines."""
    paired = F.zip_with(
        old,
        new,
        lambda o, n: F.struct(
            F.coalesce(o, F.lit("")).alias("old"), F.coalesce(n, F.lit("")).alias("new")
        ),
    )
    numbered = F.transform(
        paired,
        lambda p, i: F.struct(
            (i + 1).cast("int").alias("line_num"), p["old"].alias("old"), p["new"].alias("new")
        ),
    )
    return F.slice(F.filter(numbered, lambda p: p["old"] != p["new"]), 1, limit)


def duration_text(seconds: Column) -> Column:
    """Seconds as ``Ns``, ``Nm Ns`` or ``Nh Nm Ns``."""
    whole = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 0, F.lit("0s"))
        .when(seconds < 60, F.concat(F.bround(seconds, 0).cast("long").cast("string"), F.lit("s")))
        .when(
            whole < 3600,
            F.concat((whole / 60).cast("long"), F.lit("m "), (whole % 60), F.lit("s")),
        )
        .otherwise(
            F.concat(
                (whole / 3600).cast("long"),
                F.lit("h "),
                ((whole % 3600) / 60).cast("long"),
                F.lit("m "),
                (whole % 60),
                F.lit("s"),
            )
        )
    )


def gap_sentence(missing: Column) -> Column:
    """English list of missing aspects."""
    head = F.slice(missing, 1, F.greatest(F.size(missing) - 1, F.lit(0)))
    return (
        F.when(F.size(missing) == 0, F.lit(""))
        .when(F.size(missing) == 1, F.concat(F.lit("Missing aspect: "), F.get(missing, F.lit(0))))
        .otherwise(
            F.concat(
                F.lit("Missing aspects: "),
                F.array_join(head, ", "),
                F.lit(", and "),
                F.element_at(missing, -1),
            )
        )
    )


def percent(share: Column) -> Column:
    """Whole percent as text, halves to even."""
    return F.bround(share * 100, 0).cast("long").cast("string")


def rounded(value: Column, digits: int) -> Column:
    """Rounded as the exact binary value demands, exact halves to even; keeps the sign of 0.

    0.075 lies just below its decimal text, so it becomes 0.07. The product with the power
    of ten is taken together with its rounding error (split into halves of 26 bits).
    """
    power = F.lit(10.0**digits)
    x = F.abs(value.cast("double"))

    def halves(v: Column) -> tuple[Column, Column]:
        high = v * F.lit(134217729.0) - (v * F.lit(134217729.0) - v)
        return high, v - high

    product = x * power
    (xh, xl), (ph, pl) = halves(x), halves(power)
    error = ((xh * ph - product) + xh * pl + xl * ph) + xl * pl
    whole = F.floor(product).cast("double")
    past_half = (product - whole - F.lit(0.5)) + error
    up = (past_half > 0) | ((past_half == 0) & (whole % 2 == 1))
    out = (whole + up.cast("double")) / power
    return F.when(value < 0, -out).otherwise(out)


def fixed(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, halves to even; keeps the sign of -0.00."""
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.format_string(f"%.{digits}f", rounded(F.abs(value), digits)))
