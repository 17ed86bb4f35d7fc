"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

SuperMinHash gives each shingle a random permutation of the registers and draws its
values rank by rank, so the registers of one set are negatively correlated and small
sets get signatures of lower variance. Ranks are taken for all shingles of a group of
texts at once and stop early: once every register of a set holds less than rank j, no
shingle of later ranks can change it.

Copies (equal shingle sets) are grouped first, so a class of any size is one row from
there on. Texts that share a band meet in stars, not in pairs: each is verified against
one centre of its bucket, then, where several components are left, against other centres.
What still lies apart from a bucket's largest component is compared with all its members
block by block, which leaves no candidate out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import ragged
from tessella.llm.common import quoted
from tessella.scale import cut, free_files, gathered

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
# Centres that a bucket with several components tries before its blocks are compared.
STAR_TURNS = 4
# Members of one block of a bucket that is compared pair by pair.
BLOCK = 128


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the n + 1 offsets of the texts.

    Words are runs of bytes other than white space (0x20, 0x09-0x0D), A-Z lower-cased. A
    text with fewer words than a shingle is one shingle; one without words has none.
    """
    data = np.frombuffer("\n".join(texts).encode("utf-8"), np.uint8)
    lengths = np.fromiter((len(t.encode("utf-8")) for t in texts), np.int64, len(texts))
    ends_of = np.cumsum(lengths + 1) - 1
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    starts, ends = ragged.runs(solid, np.zeros(len(data), bool))
    word = ragged.span_hashes(data, starts, ends)
    owner = np.searchsorted(ends_of, starts, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    last = np.cumsum(n_words)
    size = np.minimum(np.maximum(n_words, 1), words)
    # the shingle that starts at each word, built word by word for all of them
    shingle = np.zeros(len(word), np.uint64)
    width = np.minimum(size[owner], last[owner] - np.arange(len(word)))
    for k in range(words):
        at = np.flatnonzero(width > k)
        shingle[at] = ragged.mix(shingle[at] * np.uint64(0x9E3779B97F4A7C15) + word[at + k])
    full = width == size[owner]
    shingle, owner = shingle[full], owner[full]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[new], owner[new]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(texts)), out=offsets[1:])
    return shingle, offsets


def super_minhash(elements: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (sets x registers) of sets of 64-bit hashes.

    Register values are rank + draw as 32.32 fixed point numbers. Only sets that still have
    a register at or above the current rank take part in the next one.
    """
    sizes = np.diff(offsets)
    signatures = np.full((len(sizes), registers), np.iinfo(np.uint64).max, np.uint64)
    live = np.flatnonzero(sizes > 0)
    owner = np.repeat(live, sizes[live])
    hashes = elements
    swapped: np.ndarray | None = None  # each live element's permutation, from rank 1 on
    for rank in range(registers):
        if not len(owner):
            break
        draw = ragged.mix(hashes + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = (draw >> np.uint64(32)) | (np.uint64(rank) << np.uint64(32))
        pick = rank + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(registers - rank) >> np.uint64(32)).astype(np.int64)
        if swapped is None:
            target = pick
        else:
            target = swapped[np.arange(len(owner)), pick].astype(np.int64)
        np.minimum.at(signatures.reshape(-1), owner * registers + target, value)
        if rank + 1 == registers:
            break
        going = signatures.max(axis=1) >= np.uint64(rank + 1) << np.uint64(32)
        going &= sizes > 0
        stay = going[owner]
        if swapped is None:
            swapped = np.tile(np.arange(registers, dtype=np.int16), (int(stay.sum()), 1))
        else:
            swapped = swapped[stay]
        hashes, owner, pick, target = hashes[stay], owner[stay], pick[stay], target[stay]
        lines = np.arange(len(owner))
        swapped[lines, pick] = swapped[:, rank]
        swapped[lines, rank] = target
    return signatures


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    out = np.zeros((len(signatures), BANDS), np.uint64)
    for band in range(BANDS):
        value = np.full(len(signatures), band + 1, np.uint64)
        for row in range(ROWS):
            value = ragged.mix(value * np.uint64(0x9E3779B97F4A7C15) + signatures[:, band * ROWS + row])
        out[:, band] = value
    return out


def _signed(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, texts = batch["row"].to_numpy(), batch["text"].tolist()
        for first, group in ragged.groups(texts, 1 << 19):
            sets, offsets = shingle_sets(group, words)
            sizes = np.diff(offsets)
            bands = band_hashes(super_minhash(sets, offsets))
            # two independent sums identify the whole set
            identity = []
            for seed in (1, 2):
                total = np.zeros(len(sets) + 1, np.uint64)
                np.cumsum(ragged.mix(sets + np.uint64(seed * 0xA24BAED4963EE407 & (1 << 64) - 1)), out=total[1:])
                identity.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
            yield pd.DataFrame(
                {
                    "row": rows[first : first + len(group)],
                    "n_shingles": sizes,
                    "set_a": identity[0],
                    "set_b": identity[1],
                    "bands": [b.view(np.int64) if n else np.zeros(0, np.int64) for b, n in zip(bands, sizes, strict=True)],
                }
            )
            del sets, bands
    ragged.give_back()


def exact_shingles(text: str, words: int) -> frozenset[str]:
    """The shingles themselves, for the verification."""
    table = {c: c + 32 for c in range(65, 91)}
    table |= {c: " " for c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D)}
    found = [w for w in text.translate(table).split(" ") if w]
    if len(found) < words:
        return frozenset([" ".join(found)]) if found else frozenset()
    return frozenset(" ".join(found[i : i + words]) for i in range(len(found) - words + 1))


def linked(a: frozenset[str], b: frozenset[str], percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(a & b)
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def _verified(batches: Iterator[pd.DataFrame], words: int, percent: int) -> Iterator[pd.DataFrame]:
    """Pairs (a, b, text_a, text_b) that link; the centre's set is kept while it repeats."""
    held, centre = None, frozenset()
    for batch in batches:
        keep = []
        for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
            if held != b:
                held, centre = b, exact_shingles(text_b, words)
            keep.append(linked(exact_shingles(text_a, words), centre, percent))
        yield batch.loc[keep, ["a", "b"]]
    ragged.give_back()


def _block_links(block: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """Links of the strays of one block with its members of other components.

    Pairs whose components an earlier link has joined need no comparison, so the result has
    fewer rows than the block.
    """
    root = {c: c for c in block["component"]}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    strays, members = block[block["stray"]], block[~block["stray"]]
    sets = {r: exact_shingles(t, words) for r, t in zip(block["row"], block["text"], strict=True)}
    found = []
    for a, own in zip(strays["row"], strays["component"], strict=True):
        for b, other in zip(members["row"], members["component"], strict=True):
            if find(own) != find(other) and linked(sets[a], sets[b], percent):
                root[find(own)] = find(other)
                found.append((a, b))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(row, component): the smallest row reachable over the links, for linked rows only.

    Alternating large-star and small-star rounds, each written to the shared checkpoint
    folder, until the stars stand; the rows of each round never outnumber the links. A round
    over few rows runs in one task, so it leaves few files behind.
    """
    edges = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state, size = None, edges.count()
    ways = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    for _ in range(rounds):
        both = gathered(edges, 2 * size).select(ways)
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = gathered(large, 2 * size).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.select("b", "m").union(down.select(F.col("a").alias("b"), "m"))
        small = gathered(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")), 2 * size)
        edges = cut(small.distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == now:
            return edges.select(F.col("a").alias("row"), F.col("b").alias("component"))
        state, size = now, now["n"]
    raise RuntimeError("components did not settle; raise the number of rounds")


def near_duplicates(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 4,
    percent: int = 80,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept.

    Texts are linked where 100 * intersection >= percent * union of their shingle sets.
    NULL and empty texts, and those without words, have no shingles and stay alone. A row
    with a NULL id is linked with nothing: its component_id is NULL and it is kept. Rows
    repeated under one id share its component and are both kept if the id is the smallest.
    Other columns are not read. An empty table gives an empty result.
    """
    texts = df.select(quoted(id_column).cast("long").alias("row"), quoted(text_column).alias("text"))
    known = texts.where(F.col("row").isNotNull() & F.col("text").isNotNull())
    signed = cut(
        known.mapInPandas(
            lambda batches: _signed(batches, words),
            "row long, n_shingles long, set_a long, set_b long, bands array<long>",
        )
    )
    # equal sets: one class, named by its smallest row
    filled = signed.where("n_shingles > 0")
    classes = filled.groupBy("set_a", "set_b", "n_shingles").agg(
        F.min("row").alias("class"), F.min("bands").alias("bands")
    )
    buckets = cut(
        classes.select("class", "n_shingles", F.explode("bands").alias("bucket"))
    )
    crowded = buckets.groupBy("bucket").agg(
        F.min("class").alias("centre"),
        F.min_by("n_shingles", "class").alias("centre_size"),
        F.count("*").alias("members"),
    )
    crowded = cut(crowded.where("members > 1"))
    sizes = buckets.join(crowded, "bucket")
    stars = sizes.where((F.col("class") != F.col("centre")) & _comparable("n_shingles", "centre_size", percent))
    stars = stars.select(F.col("class").alias("a"), F.col("centre").alias("b")).distinct()
    wanted = sizes.select("class").distinct()
    body = cut(
        known.join(wanted.withColumnRenamed("class", "row"), "row").groupBy("row").agg(F.min("text").alias("text"))
    )
    links = cut(_verify(stars, body, words, percent))
    linked_rows = components(links).withColumnRenamed("row", "class")
    state = cut(
        wanted.join(linked_rows, "class", "left").select(
            F.col("class").alias("row"), F.coalesce("component", "class").alias("component")
        )
    )
    members = cut(sizes.select("bucket", F.col("class").alias("row"), F.col("n_shingles").alias("size")))
    rows_met = members.count()
    for turn in range(STAR_TURNS):
        free_files(df.sparkSession)  # the texts that the last turn moved
        state, more = _star_turn(members, state, rows_met, body, turn, words, percent)
        if not more:
            break
    free_files(df.sparkSession)
    state = _joined(state, cut(_compare_rest(members.join(state, "row"), body, words, percent)))
    found = state.withColumnRenamed("row", "class")
    rows = signed.join(
        classes.select("set_a", "set_b", "n_shingles", "class"), ["set_a", "set_b", "n_shingles"], "left"
    )
    placed = (
        rows.join(found, "class", "left")
        .select("row", "n_shingles", F.coalesce("component", "class", "row").alias("component_id"))
    )
    unknown = texts.where(F.col("row").isNull() | F.col("text").isNull()).select(
        "row", F.lit(0).cast("long").alias("n_shingles"), F.col("row").alias("component_id")
    )
    return placed.unionByName(unknown).select(
        F.col("row").alias(id_column),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("row") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _verify(pairs: DataFrame, body: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets link."""
    return (
        pairs.join(body.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
        .join(body.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInPandas(lambda batches: _verified(batches, words, percent), "a long, b long")
    )


def _joined(state: DataFrame, links: DataFrame) -> DataFrame:
    """``state`` (row, component) after links (a, b) between rows; components keep the name
    of their smallest row."""
    size = links.count()
    if not size:
        return state
    links = gathered(links, size)
    named = gathered(links.join(state.select(F.col("row").alias("a"), F.col("component").alias("ca")), "a"), size).join(
        state.select(F.col("row").alias("b"), F.col("component").alias("cb")), "b"
    )
    moved = components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(
        F.col("row").alias("component"), F.col("component").alias("now")
    )
    return cut(
        state.join(moved, "component", "left").select("row", F.coalesce("now", "component").alias("component"))
    )


def _comparable(a: str, b: str, percent: int) -> Column:
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _star_turn(
    members: DataFrame, state: DataFrame, n: int, body: DataFrame, turn: int, words: int, percent: int
) -> tuple[DataFrame, bool]:
    """One more centre, drawn by hash, for each bucket (``n`` of bucket, row, size) that still holds
    several components; each row outside the centre's component meets one of the centres of
    its buckets. The new state, and whether there was any such bucket."""
    named = gathered(gathered(members, n).join(gathered(state, n), "row"), n)
    draw = F.xxhash64("row", F.lit(turn))
    drawn = named.groupBy("bucket").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.min_by("row", draw).alias("b"),
        F.min_by("component", draw).alias("other"),
        F.min_by("size", draw).alias("other_size"),
    )
    met = gathered(named.join(drawn.where("low < high"), "bucket"), n).where(
        (F.col("component") != F.col("other")) & _comparable("size", "other_size", percent)
    )
    pairs = met.groupBy(F.col("row").alias("a")).agg(F.min_by("b", F.xxhash64("b", F.lit(turn))).alias("b"))
    pairs = cut(pairs)
    if pairs.isEmpty():
        return state, False
    return _joined(state, cut(_verify(pairs, body, words, percent))), True


def _compare_rest(named: DataFrame, body: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the components that still meet in a bucket, block against block.

    ``named`` has (bucket, row, component). All members outside a bucket's largest component
    are compared with all members of other components: blocks of about BLOCK of the former
    each meet every block of the bucket in one task. No candidate is left out, and a large
    component next to a few strays costs its size, not its square.
    """
    per = named.groupBy("bucket", "component").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("sum")
    )
    open_ = per.groupBy("bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        F.sum("n").alias("members"),
        F.max("n").alias("most"),
        F.count("*").alias("kinds"),
        F.sum("sum").alias("group"),  # equal members in several buckets need one comparison
    )
    open_ = open_.where("kinds > 1").groupBy("group", "members").agg(F.min_by(F.struct("*"), "bucket").alias("o"))
    counts = open_.select(
        "o.bucket",
        "o.main",
        F.ceil(F.col("members") / F.lit(BLOCK)).cast("int").alias("blocks"),
        F.ceil((F.col("members") - F.col("o.most")) / F.lit(BLOCK)).cast("int").alias("strays"),
    )
    placed = named.join(counts, "bucket").select(
        "bucket",
        "row",
        "component",
        "blocks",
        "strays",
        F.pmod(F.xxhash64("row", F.lit("block")), "blocks").cast("int").alias("block"),
        F.when(
            F.col("component") != F.col("main"), F.pmod(F.xxhash64("row", F.lit("stray")), "strays").cast("int")
        ).alias("stray"),
    )
    each = ("bucket", "row", "component")
    right = placed.select(*each, F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("stray"))
    left = placed.where("stray is not null").select(
        *each, F.col("stray").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("stray")
    )
    return (
        left.unionByName(right)
        .join(body, "row")
        .groupBy("bucket", "i", "j")
        .applyInPandas(lambda block: _block_links(block, words, percent), "a long, b long")
        .distinct()
    )
