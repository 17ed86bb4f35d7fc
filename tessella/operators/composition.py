"""Composition of candidate lists: connectors, gaps, overlaps, contradictions.

All pairwise work happens inside one query's candidate list, which the top-k cut
bounds; nothing compares the archive with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.config import DEFAULT, CompositionConfig
from tessella.functions import words as W
from tessella.scale import cut


def frequent_words(texts: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """``key, frequent``: up to ``limit`` repeated longer words of each row, most common first,
    then by first place.

    Counts are run lengths of the row's own sorted words, so nothing is shuffled.
    """
    item = lambda w, i: F.struct(F.lower(w).alias("word"), i.alias("pos"), F.length(w).alias("n"))
    longer = F.filter(F.transform("_ws", item), lambda x: x["n"] > 3)
    rows = texts.select(key, W.words(F.col(text)).alias("_ws")).select(key, F.array_sort(longer).alias("_s"))
    differs = lambda i: (i == 0) | (F.get("_s", i)["word"] != F.get("_s", i - 1)["word"])
    places = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_a", F.filter(places, differs))
    rows = rows.withColumn("_b", F.concat(F.slice("_a", 2, F.greatest(F.size("_a"), F.lit(1))), F.array(F.size("_s"))))
    run = lambda a, b: F.struct((a - b).alias("n"), F.get("_s", a)["pos"].alias("first"), F.get("_s", a)["word"].alias("word"))
    runs = F.zip_with("_a", "_b", run)
    best = F.slice(F.array_sort(F.filter(runs, lambda r: r["n"] <= -2)), 1, limit)
    return rows.select(key, F.transform(best, lambda r: r["word"]).alias("frequent"))


def connectors(fragments: DataFrame, key: str = "id") -> DataFrame:
    """``key, tabs, slots`` of stored rows: what each provides and answers."""
    frequent = frequent_words(fragments, key, "content", 8)
    topic = F.when(F.col("topic") != "", F.array("topic")).otherwise(
        F.array().cast("array<string>")
    )
    parts = fragments.select(
        key,
        topic.alias("topic_part"),
        "tags",
        F.slice(W.capitalised(F.col("content")), 1, 5).alias("caps"),
        W.definitions(F.col("content")).alias("definitions"),
    )
    none = F.array().cast("array<string>")
    return parts.join(frequent, key, "left").select(
        key,
        F.slice(
            F.array_distinct(
                F.concat("topic_part", "tags", "caps", F.coalesce("frequent", none))
            ),
            1,
            10,
        ).alias("tabs"),
        F.slice(F.array_distinct(F.concat("topic_part", "definitions")), 1, 10).alias("slots"),
    )


def text_connectors(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tabs, slots`` of free text without metadata."""
    frequent = frequent_words(texts, key, text, 5)
    none = F.array().cast("array<string>")
    return (
        texts.select(
            key,
            F.slice(W.capitalised(F.col(text)), 1, 5).alias("caps"),
            F.slice(F.array_distinct(W.lead_phrases(F.col(text))), 1, 10).alias("slots"),
        )
        .join(frequent, key, "left")
        .select(
            key,
            F.slice(
                F.array_distinct(F.concat("caps", F.coalesce("frequent", none))), 1, 10
            ).alias("tabs"),
            "slots",
        )
    )


def _pairs(rows: Column, keep) -> Column:
    """Structs for index pairs i < j of a short list for which ``keep`` is not NULL."""
    return F.flatten(
        F.transform(
            rows,
            lambda a, i: F.filter(
                F.transform(
                    F.slice(rows, i + 2, F.greatest(F.size(rows) - i - 1, F.lit(0))),
                    lambda b: keep(a, b),
                ),
                lambda p: p.isNotNull(),
            ),
        )
    )


def with_word_sets(scanned: DataFrame) -> DataFrame:
    """Add ``members``: per certified candidate its id, word set and antonym sides."""
    base = F.transform(
        "certified",
        lambda c: F.struct(c["id"].alias("id"), W.word_set(c["content"]).alias("ws")),
    )
    return scanned.withColumn("_base", base).withColumn(
        "members",
        F.transform(
            "_base",
            lambda m: F.struct(
                m["id"].alias("id"),
                m["ws"].alias("ws"),
                W.antonym_sides(m["ws"], 0).alias("left"),
                W.antonym_sides(m["ws"], 1).alias("right"),
            ),
        ),
    ).drop("_base")


def find_overlaps(members: Column, config: CompositionConfig = DEFAULT.composition) -> Column:
    def keep(a, b):
        score = W.jaccard(a["ws"], b["ws"])
        return F.when(
            score > config.overlap_above,
            F.struct(a["id"].alias("a"), b["id"].alias("b"), score.alias("score")),
        )

    return _pairs(members, keep)


def find_contradictions(
    members: Column, config: CompositionConfig = DEFAULT.composition
) -> Column:
    def keep(a, b):
        score = W.antonym_score(a["left"], a["right"], b["left"], b["right"])
        return F.when(
            (score > config.warn_above) & (W.jaccard(a["ws"], b["ws"]) > config.warn_above),
            F.struct(a["id"].alias("a"), b["id"].alias("b"), score.alias("score")),
        )

    return _pairs(members, keep)


def find_gaps(scanned: DataFrame, fragments: DataFrame) -> DataFrame:
    """Add ``query_aspects`` and ``gaps``: aspects that no candidate covers.

    ``scanned`` is read twice here; pass a materialised one (see :func:`compose`).
    """
    used = scanned.select(
        "qid", F.explode(F.transform("certified", lambda c: c["id"])).alias("id")
    )
    picked = fragments.join(used.select("id").distinct(), "id", "left_semi")
    links = (
        connectors(picked)
        .withColumn(
            "terms", F.transform(F.concat("tabs", "slots"), F.lower)
        )
        .join(used, "id")
        .groupBy("qid")
        .agg(F.flatten(F.collect_list("terms")).alias("terms"))
    )
    low_contents = F.transform("certified", lambda c: c["content_lc"])

    def covered(aspect):
        low = F.lower(aspect)
        return F.exists(
            low_contents, lambda c: F.forall(W.words(low), lambda w: c.contains(w))
        ) | F.exists(F.coalesce("terms", F.array().cast("array<string>")), lambda t: t.contains(low))

    return (
        scanned.join(links, "qid", "left")
        .withColumn("query_aspects", W.composition_aspects(F.col("text")))
        .withColumn("gaps", F.filter("query_aspects", lambda a: ~covered(a)))
        .drop("terms")
    )


def joined_text(rows: Column) -> Column:
    """Stripped contents by quality, ties in list order, with a blank line between."""
    ordered = F.array_sort(
        F.transform(
            rows, lambda r, i: F.struct((-r["quality"]).alias("q"), i.alias("i"), W.strip(r["content"]).alias("t"))
        )
    )
    texts = F.filter(F.transform(ordered, lambda r: r["t"]), lambda t: t != "")
    return F.array_join(texts, "\n\n")


def compose(
    scanned: DataFrame, fragments: DataFrame, config: CompositionConfig = DEFAULT.composition
) -> DataFrame:
    """Composition verdict per query over its certified candidates."""
    checked = with_word_sets(find_gaps(cut(scanned), fragments))
    checked = checked.withColumn("overlaps", find_overlaps(F.col("members"), config)).withColumn(
        "contradictions", find_contradictions(F.col("members"), config)
    )
    empty = F.size("certified") == 0
    blocked = F.exists("contradictions", lambda c: c["score"] > config.block_above)
    has_gaps = F.size("gaps") > 0
    gap_lines = F.concat(
        F.lit("\n\n---\n"),
        F.array_join(F.transform("gaps", lambda g: F.concat(F.lit("[Missing: "), g, F.lit("]"))), "\n"),
    )
    body = joined_text(F.col("certified"))
    output = (
        F.when(empty | blocked, F.lit(""))
        .when(has_gaps, F.concat(body, gap_lines))
        .otherwise(body)
    )
    return (
        checked.withColumn("blocked", ~empty & blocked)
        .withColumn("success", ~empty & ~blocked)
        .withColumn("partial", ~empty & ~blocked & has_gaps)
        .withColumn("output", output)
        .withColumn(
            "gaps", F.when(empty, F.array(F.lit("entire_query"))).otherwise(F.col("gaps"))
        )
        .drop("members")
    )


def extend_gaps(composed: DataFrame, description: Column) -> DataFrame:
    """Partial composition: add the aspects named in a gap sentence."""
    bare = F.regexp_replace(description, "Missing aspects?: ", "")
    named = F.filter(
        F.transform(F.split(bare, ", and |, "), W.strip), lambda a: a != ""
    )
    applies = F.col("success") & (description != "")
    return composed.withColumn(
        "gaps", F.when(applies, F.array_union("gaps", named)).otherwise(F.col("gaps"))
    ).withColumn("partial", F.col("partial") | applies)
