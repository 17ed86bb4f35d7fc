"""Trie of conversation prefixes, with subtree totals by parallel tree contraction.

A prefix is named by 128 bits: the XOR over its turns of hashes of (place, turn). Names of all
prefixes are running XORs, taken in blocks of ``BLOCK_TURNS`` places, so a conversation that
holds a large share of all turns is spread over tasks, and a prefix that many conversations
share is counted by partial aggregates.

Totals follow from contraction rounds over (id, parent, number of kids, XOR of the kids' ids,
values). A round rakes: each leaf adds its values to its parent and leaves. Then it compresses:
of neighbours with a single kid, the one with the smallest hash of the round leaves; its values
go to its parent, and its kid moves up. As the XOR of one kid is that kid, a node knows both
neighbours without a join, and each half of a round is one grouped aggregation. A chain
loses about a third of its nodes per round, so rounds grow with the logarithm of the size.
Rounds are then undone from the last one: a compressed node's total is its values plus the
total of the kid that it had. Tables shrink geometrically from round to round, so all rounds
together cost a few passes over the nodes.

Every round ends in a checkpoint in the shared folder, from which lost executors go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import quoted
from tessella.scale import cut, running_position

BLOCK_TURNS = 1 << 16
# Ids of one text that are hashed in a row.
PIECE_IDS = 4096


def subtree_sums(forest: DataFrame, values: list[str]) -> DataFrame:
    """Sum of each value over every subtree of a forest.

    ``forest`` has unique long ``id``, ``parent`` (NULL at roots, else an id of the table) and
    long values without NULLs. Returns id and the sums. An empty table gives an empty one.
    """
    kids = forest.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("kids"), F.bit_xor("id").alias("kid")
    )
    state = forest.select("id", "parent", *values).join(kids, "id", "left").withColumns(
        {"kids": F.coalesce("kids", F.lit(0).cast("long")), "kid": F.coalesce("kid", F.lit(0).cast("long")), "via": F.lit(None).cast("long")}
    )
    rounds = [cut(state)]
    while not (live := rounds[-1].where(F.col("via").isNull())).isEmpty():
        rounds.append(cut(_compress(_rake(live, values), values, len(rounds))))
    totals = rounds[-1].select("id", *values)
    for before, after in zip(rounds[-2::-1], rounds[:0:-1]):
        spliced = after.where(F.col("via").isNotNull()).select(
            F.col("via").alias("at"), F.struct("id", *values).alias("own")
        )
        whole = F.struct("id", *values)
        plus = F.struct(F.col("own.id"), *[(F.col(f"own.{v}") + F.col(v)).alias(v) for v in values])
        both = totals.where(F.col("id").isNotNull()).join(spliced, F.col("id") == F.col("at"), "left").select(
            F.inline(F.when(F.col("own").isNull(), F.array(whole)).otherwise(F.array(whole, plus)))
        )
        raked = before.where((F.col("kids") == 0) & F.col("via").isNull()).select("id", *values)
        totals = cut(both.unionByName(raked))
    return totals


def _rake(live: DataFrame, values: list[str]) -> DataFrame:
    """Leaves add their values to their parents and are gone."""
    leaf = F.col("kids") == 0
    sent = live.where(~(leaf & F.col("parent").isNull())).select(
        F.when(leaf, F.col("parent")).otherwise(F.col("id")).alias("id"),
        F.when(~leaf, F.col("parent")).alias("parent"),
        F.when(leaf, F.lit(-1)).otherwise(F.col("kids")).alias("kids"),
        F.when(leaf, F.col("id")).otherwise(F.col("kid")).alias("kid"),
        *values,
    )
    return sent.groupBy("id").agg(
        F.max("parent").alias("parent"),
        F.sum("kids").alias("kids"),
        F.bit_xor("kid").alias("kid"),
        *[F.sum(v).alias(v) for v in values],
    )


def _compress(live: DataFrame, values: list[str], turn: int) -> DataFrame:
    """Independent inner nodes of unary chains leave; they stay listed with their kid as ``via``."""
    mark = lambda name: F.xxhash64(F.lit(turn), F.col(name))
    chosen = (
        F.col("parent").isNotNull() & (F.col("kids") == 1) & (mark("id") < mark("kid")) & (mark("id") < mark("parent"))
    )
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    fields = ("id", "parent", "moved", "kids", "kid", "via", *values)

    def row(*columns: Column) -> Column:
        return F.struct(*[c.alias(f) for c, f in zip(columns, fields)])

    own = [F.col(v) for v in values]
    nothing = [zero] * len(values)
    stays = row(F.col("id"), F.col("parent"), none, F.col("kids"), F.col("kid"), none, *own)
    gone = row(F.col("id"), F.col("parent"), none, F.col("kids"), F.col("kid"), F.col("kid"), *own)
    up = row(F.col("parent"), none, none, zero, F.col("kid").bitwiseXOR(F.col("id")), none, *own)
    down = row(F.col("kid"), none, F.col("parent"), zero, zero, none, *nothing)
    sent = live.select(F.inline(F.when(chosen, F.array(gone, up, down)).otherwise(F.array(stays))))
    return (
        sent.groupBy("id")
        .agg(
            F.coalesce(F.max("moved"), F.max("parent")).alias("parent"),
            F.sum("kids").alias("kids"),
            F.bit_xor("kid").alias("kid"),
            F.max("via").alias("via"),
            *[F.sum(v).alias(v) for v in values],
        )
        .select("id", "parent", *values, "kids", "kid", "via")
    )


def numbered_turns(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(c, pos, t1, t2, bytes): each turn's place from 1, two hashes and its text's UTF-8 bytes.

    Places follow ``turn``, NULL first; ties go by role, then by the MD5 of the text.
    """
    said = F.coalesce(quoted(text), F.lit(""))
    rows = conversations.where(quoted(conv).isNotNull()).select(
        quoted(conv).cast("long").alias("c"),
        quoted(turn).cast("long").alias("turn"),
        F.coalesce(quoted(role), F.lit("")).alias("role"),
        F.md5(said.cast("binary")).alias("digest"),
        F.octet_length(said).cast("long").alias("bytes"),
    )
    name = lambda seed: F.xxhash64(F.lit(seed), F.col("role"), F.col("digest"))
    return running_position(rows, ["c"], ["turn", "role", "digest"], "pos").select(
        "c", "pos", name(1).alias("t1"), name(2).alias("t2"), "bytes"
    )


def as_they_are(turns: DataFrame) -> DataFrame:
    """(c, i, t1, t2, bytes, last) of whole conversations, with a row of place 0 each."""
    top = turns.groupBy("c").agg(F.max("pos").alias("n"))
    rows = turns.join(top, "c").select("c", F.col("pos").alias("i"), "t1", "t2", "bytes", (F.col("pos") == F.col("n")).alias("last"))
    return rows.unionByName(top.select("c", *_root(F.lit(False))))


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """As ``as_they_are``, after the head of every conversation c was exchanged.

    The first h = CRC-32(decimal c) % 9 turns of conversation c - c % 5 (all if fewer, none if
    it is absent) come first, then c's own turns after its first h.
    """
    few = F.when(F.col("pos") <= 8, F.struct("pos", "t1", "t2", "bytes"))
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(few)).alias("head"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % 9
    lender = convs.select(F.col("c").alias("base"), F.col("head").alias("lent"))
    infos = (
        convs.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % 5).alias("base"))
        .join(lender, "base", "left")
        .withColumn("lent", F.coalesce(F.slice("lent", 1, F.col("h").cast("int")), F.slice(F.array(F.struct(*[F.lit(0).cast("long").alias(x) for x in ("pos", "t1", "t2", "bytes")])), 1, 0)))
        .withColumn("k", F.size("lent").cast("long"))
        .withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    place = F.col("k") + F.col("pos") - F.col("h")
    own = turns.join(infos.select("c", "h", "k", "len"), "c").where(F.col("pos") > F.col("h"))
    own = own.select("c", place.alias("i"), "t1", "t2", "bytes", (place == F.col("len")).alias("last"))
    head = infos.select("c", "len", F.inline("lent")).select(
        "c", F.col("pos").alias("i"), "t1", "t2", "bytes", (F.col("pos") == F.col("len")).alias("last")
    )
    return own.unionByName(head).unionByName(infos.select("c", *_root(F.col("len") == 0)))


def _root(last: Column) -> list[Column]:
    return [*[F.lit(0).cast("long").alias(x) for x in ("i", "t1", "t2", "bytes")], last.alias("last")]


def named_prefixes(turns: DataFrame, block: int | None = None) -> DataFrame:
    """(c, depth, k1, k2, p1, p2, bytes, last): names of each prefix and of its parent."""
    block = block or BLOCK_TURNS
    rows = turns.select(
        "c", F.col("i").alias("depth"), "bytes", "last", F.expr(f"i div {block}").alias("blk"),
        *[F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("i", t)).alias(w) for t, w in (("t1", "w1"), ("t2", "w2"))],
    )
    upto = Window.partitionBy("c", "blk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("c", "blk").agg(F.bit_xor("w1").alias("w1"), F.bit_xor("w2").alias("w2"))
    offsets = blocks.select("c", "blk", F.bit_xor("w1").over(before).alias("o1"), F.bit_xor("w2").over(before).alias("o2"))
    run = rows.withColumns({"k1": F.bit_xor("w1").over(upto), "k2": F.bit_xor("w2").over(upto)}).join(offsets, ["c", "blk"], "left")
    for x in "12":
        run = run.withColumn(f"k{x}", F.col(f"k{x}").bitwiseXOR(F.coalesce(f"o{x}", F.lit(0))))
        run = run.withColumn(f"p{x}", F.col(f"k{x}").bitwiseXOR(F.col(f"w{x}")))
    return run.select("c", "depth", "k1", "k2", "p1", "p2", "bytes", "last")


KEY = ["depth", "k1", "k2"]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) rows as (key, first id, ids joined by commas) of bounded length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
        ids = batch.column(3).to_numpy()
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        starts = [s for a, b in zip([0, *edges], [*edges, len(ids)]) for s in range(a, b, PIECE_IDS)]
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(ids)])]
        columns = [*keys[starts].T, ids[starts]]
        yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array(texts)], [*KEY, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over all pieces of a key, which come in order; one piece is held at a time."""
    at, state, rows = None, None, []

    def result() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*KEY, "sha"])

    for batch in batches:
        for *key, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
            if key == at:
                state.update(b",")
            else:
                if at is not None:
                    rows.append((*at, state.hexdigest()))
                at, state = key, hashlib.sha256()
            state.update(text.encode())
        if len(rows) >= 10_000:
            yield result()
            rows = []
    if at is not None:
        rows.append((*at, state.hexdigest()))
    if rows:
        yield result()


def ends_digests(prefixes: DataFrame) -> DataFrame:
    """SHA-256 of the sorted ids that end at each node. Ids are sorted over all tasks, so one
    node of very many ends is cut into pieces, which alone are put together."""
    kind = ", ".join(f"{k} long" for k in KEY)
    ends = prefixes.where("last").select(*KEY, "c")
    pieces = ends.repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c").mapInArrow(_pieces, f"{kind}, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, f"{kind}, sha string")


def prefix_trie(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    rebuild: Callable[[DataFrame], DataFrame] = as_they_are,
) -> DataFrame:
    """One row per distinct sequence of first turns (role, text), from the empty root on.

    Columns, long but for the digest: conv_id, the smallest conversation that begins with the
    sequence; depth, its turns; parent_conv_id, the parent's conv_id (NULL at the root); n_convs;
    n_children; n_leaves, nodes without children in the subtree; saved_tokens, over the subtree
    the sum of (n_convs - 1) times the UTF-8 bytes of a node's last text; ends_sha256, of the
    sorted decimal ids, with commas between, of the conversations that end here.

    ``rebuild`` may change the numbered turns. NULL roles and texts count as empty ones; rows of
    a NULL conversation belong to none and are left out; repeated rows are turns of their own;
    turns of one number go by role and MD5 of the text. Texts are hashed whole. An empty table
    gives no rows. Other columns are not read.
    """
    prefixes = cut(named_prefixes(rebuild(numbered_turns(conversations, conv, turn, role, text))))
    grouped = prefixes.groupBy(*KEY).agg(
        F.min("c").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        *[F.min(x).alias(x) for x in ("p1", "p2", "bytes")],
    )
    nodes = cut(grouped.withColumn("id", F.monotonically_increasing_id()))
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
    )
    linked = nodes.join(above, ["depth", "p1", "p2"], "left")
    children = linked.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = cut(
        linked.join(children, "id", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        .withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    )
    totals = subtree_sums(tree.select("id", "parent", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    nothing = F.lit(hashlib.sha256().hexdigest())
    return (
        tree.drop("n_leaves", "saved_tokens")
        .join(totals, "id")
        .join(ends_digests(prefixes), KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("sha", nothing).alias("ends_sha256"),
        )
    )
