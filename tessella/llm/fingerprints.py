"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words, as 64-bit hashes, with their counts. For each of the
samples, every term draws from gamma distributions fixed by term and sample alone and the
smallest draw wins; two texts draw the same winner with a probability equal to the
generalised Jaccard similarity (sum of minima over sum of maxima of the weights). The share
of equal winners estimates it. Column functions and aggregates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import quoted
from tessella.scale import with_order_bucket

SAMPLES = 32
LANES = 32
WHITE = r"[\x20\x09-\x0D]+"
ID_BITS = 20
NONE = (1 << 62) - 1


def uniforms(*seeds) -> tuple[Column, Column]:
    """Two uniform numbers above 0 and below 1 from one hash."""
    bits = F.xxhash64(*seeds)
    low = bits.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")
    high = F.shiftrightunsigned(bits, 32).cast("double")
    return (low + 0.5) / F.lit(2.0**32), (high + 0.5) / F.lit(2.0**32)


def winner(term: Column, log_weight: Column, sample: Column) -> Column:
    """Draw of a term for one sample, larger bits the draw, low bits the drawn identity.

    The gamma variables r and c and the uniform b come from hashes of the term and the
    sample, so any number of terms has draws of its own.
    """

    def gamma(use: int) -> Column:
        one, two = uniforms(term, sample, F.lit(use))
        return -F.log(one * two)

    r, c, b = gamma(1), F.log(gamma(2)), uniforms(term, sample, F.lit(3))[0]
    t = F.floor(log_weight / r + b)
    # draws lie between -91 and 4; those of a term that this side lacks (NULL weight) stay NULL
    draw = c - r * (t - b) - r
    identity = F.xxhash64(term, t, sample).bitwiseAND(F.lit((1 << ID_BITS) - 1))
    return F.shiftleft(F.floor((draw + 128.0) * F.lit(2.0**34)), ID_BITS).bitwiseOR(identity)


def words_of(text: Column) -> Column:
    return F.split(text, WHITE)


def with_next(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(_bucket, _pos, _id, _text, _next, _ghost): each text with the one that follows in the
    order of ids (NULL first; equal ids by hash of the text), the last with the first.

    Rows are put in buckets that follow the order, and each bucket also gets a copy of the
    first row of the next one, its ghost, so no row needs to look beyond its bucket.
    """
    rows = df.select(
        quoted(id_column).alias("_id"),
        F.coalesce(quoted(text_column), F.lit("")).alias("_text"),
    )
    number = F.coalesce(F.col("_id").cast("long"), F.lit(-(2**63)))
    buckets = 4 * max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = with_order_bucket(rows.withColumn("_order", number), "_order", buckets)
    in_order = Window.orderBy("_bucket")  # one row per bucket
    firsts = rows.groupBy("_bucket").agg(F.min("_order").alias("_first"))
    follows = firsts.select(
        F.col("_bucket").alias("_home"),
        F.coalesce(F.lead("_first").over(in_order), F.first("_first").over(in_order)).alias("_order"),
    )
    first = Window.partitionBy("_home").orderBy("_id", F.xxhash64("_text"), "_text")
    ghosts = (
        rows.join(F.broadcast(follows), "_order")
        .withColumn("_nth", F.row_number().over(first))
        .where("_nth = 1")
        .select("_id", "_text", F.col("_home").alias("_bucket"), F.lit(True).alias("_ghost"))
    )
    together = rows.select("_id", "_text", "_bucket", F.lit(False).alias("_ghost")).unionByName(ghosts)
    # the order needs every column, so all who read these rows share one shuffle of the texts
    order = Window.partitionBy("_bucket").orderBy("_ghost", "_id", F.xxhash64("_text"), "_text")
    return together.select(
        "_bucket",
        F.row_number().over(order).alias("_pos"),
        "_id",
        "_ghost",
        "_text",
        F.coalesce(F.lead("_text").over(order), F.lit("")).alias("_next"),
    )


def fingerprint_pairs(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    samples: int = SAMPLES,
) -> DataFrame:
    """Fingerprints of each text and of its edited text.

    The edited text has the last floor(n / 4) code points replaced by the first as many of
    the next text (ids ascending, NULL first, equal ids by hash of the text; after the last
    the first). One row per input row: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A NULL text is empty; texts without words
    are alike (1.0) among themselves and unlike all others. Equal texts have equal
    fingerprints. Ids must be integers. An empty table gives an empty result; other columns
    are not read.
    """
    rows = with_next(df, id_column, text_column)
    n = F.char_length("_text")
    cut = F.floor(n / 4).cast("int")
    head, tail = F.substring("_text", F.lit(1), n - cut), F.substring("_text", n - cut + 1, cut)
    moved = F.substring("_next", F.lit(1), cut)
    base = rows.select(
        "_bucket",
        "_pos",
        "_id",
        "_ghost",
        n.cast("long").alias("n_chars"),
        F.sha2(F.concat(head, moved), 256).alias("edited_sha256"),
    )
    # the word at the cut goes with what follows it
    parted = rows.select("_bucket", "_pos", words_of(head).alias("_head"), tail.alias("_tail"), moved.alias("_moved"))
    last = F.element_at("_head", -1)
    kinds = F.array(
        F.struct(
            F.lit(1).alias("own"), F.lit(1).alias("edited"), F.slice("_head", F.lit(1), F.size("_head") - 1).alias("words")
        ),
        F.struct(F.lit(1).alias("own"), F.lit(0).alias("edited"), words_of(F.concat(last, "_tail")).alias("words")),
        F.struct(F.lit(0).alias("own"), F.lit(1).alias("edited"), words_of(F.concat(last, "_moved")).alias("words")),
    )
    at = ["_bucket", "_pos"]
    listed = parted.select(*at, F.explode(kinds).alias("_k")).select(
        *at, "_k.own", "_k.edited", F.explode("_k.words").alias("_word")
    )
    weights = (
        listed.where("_word <> ''")
        .select(*at, "own", "edited", F.xxhash64("_word").alias("term"))
        .groupBy(*at, "term")
        .agg(F.log(F.sum("own").cast("double")).alias("_w0"), F.log(F.sum("edited").cast("double")).alias("_w1"))
    )
    # wide expressions compile slowly, so each row of a term draws for LANES samples
    lanes = min(samples, LANES)
    parts = F.explode(F.sequence(F.lit(0), F.lit(-(-samples // lanes) - 1))).alias("_part")
    drawn = [
        F.min(winner(F.col("term"), F.col(f"_w{side}"), F.col("_part") * lanes + j)) for side in (0, 1) for j in range(lanes)
    ]
    identity = [F.coalesce(d, F.lit(NONE)).bitwiseAND(F.lit((1 << ID_BITS) - 1)) for d in drawn]
    partial = weights.select("*", parts).groupBy(*at, "_part").agg(
        F.array(*identity[:lanes]).alias("_f"), F.array(*identity[lanes:]).alias("_g")
    )
    whole = F.array_sort(F.collect_list(F.struct("_part", "_f", "_g")))
    winners = partial.groupBy(*at).agg(whole.alias("_parts"))
    # texts without words have no winners; both sides lie in their buckets already
    found = base.join(winners, at, "left")
    none = F.array_repeat(F.lit(NONE & ((1 << ID_BITS) - 1)), samples)

    def joined(side: str) -> Column:
        return F.coalesce(F.slice(F.flatten(F.col(f"_parts.{side}")), 1, samples), none).alias(side)

    prints = found.select(*at, "_id", "_ghost", "n_chars", "edited_sha256", joined("_f"), joined("_g"))
    order = Window.partitionBy("_bucket").orderBy("_pos")
    after = prints.withColumn("_h", F.lead("_f").over(order)).where(~F.col("_ghost"))

    def text(ids: str) -> Column:
        return F.array_join(F.transform(ids, lambda v: F.lpad(F.hex(v), ID_BITS // 4, "0")), "")

    def likeness(other: str) -> Column:
        same = F.aggregate(F.zip_with("_f", other, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)
        return same / F.lit(float(samples))

    return after.select(
        F.col("_id").alias(id_column),
        "n_chars",
        "edited_sha256",
        text("_f").alias("fingerprint"),
        text("_g").alias("edited_fingerprint"),
        likeness("_g").alias("near_edited"),
        likeness("_h").alias("near_next"),
    )

