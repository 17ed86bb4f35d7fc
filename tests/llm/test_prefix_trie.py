import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import prefix_trie as trie
from tessella.llm.prefix_trie import as_they_are, named_prefixes, prefix_trie, subtree_sums, with_shared_heads
from tessella.llm.queries import op11_prefix_trie

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            body = text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5(body.encode()).hexdigest(), body))
    convs = {c: [(r, t) for *_, r, _, t in sorted(own)] for c, own in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return convs, out


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for node, own in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = lambda n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n]
        rows.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids(node)),
            sum(not kids(m) for m in below),
            sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
            hashlib.sha256(",".join(map(str, sorted(c for c in own if len(convs[c]) == len(node)))).encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, op11_prefix_trie(spark, FOLDER).collect()), key=repr)
    assert got == brute_trie(rebuilt(rows)[1])


@pytest.mark.parametrize("heads", [False, True])
def test_random_conversations(spark, heads):
    rng = random.Random(5)
    rows = []
    for c in [*range(-6, 30), 1000, 1003, 1005]:
        for turn in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["user", None]), rng.choice(["a", "é", "", None])))
    rows += rows[:5] + [(None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit(-1) for x in ("id", "c", "pos", "depth", "parent", "kids", "n", "last")})
    df = df.repartition(3)
    plain, changed = rebuilt(rows)
    rebuild = with_shared_heads if heads else as_they_are
    got = sorted(map(tuple, prefix_trie(df, rebuild=rebuild).collect()), key=repr)
    assert got == brute_trie(changed if heads else plain)


def test_sums_of_forests(spark):
    rng = random.Random(2)
    parent = {0: None, 1: None}
    for i in range(2, 400):
        parent[i] = rng.choice([i - 1, i - 1, i - 1, 0, rng.randrange(i)])
    values = {i: rng.randrange(-5, 100) for i in parent}
    want = dict(values)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            want[parent[i]] += want[i]
    name = {i: (i * 7919) % 100_003 for i in parent}
    rows = [(name[i], None if p is None else name[p], values[i], 1) for i, p in parent.items()]
    forest = spark.createDataFrame(rows, "id long, parent long, v long, one long")
    got = {r["id"]: r["v"] for r in subtree_sums(forest, ["v", "one"]).collect()}
    assert got == {name[i]: v for i, v in want.items()}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = trie._compress
    monkeypatch.setattr(trie, "_compress", lambda *a: rounds.append(1) or plain(*a))
    n = 5000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1).cast("long").alias("v"))
    got = subtree_sums(chain, ["v"])
    assert got.where(F.col("v") != n - F.col("id")).count() == 0 and got.count() == n
    assert len(rounds) < 30


def test_names_do_not_depend_on_blocks(spark):
    turns = spark.range(50).select(F.lit(3).cast("long").alias("c"), (F.col("id") + 1).alias("i"), F.xxhash64("id").alias("t1"), F.xxhash64("id", F.lit(1)).alias("t2"), F.lit(1).cast("long").alias("bytes"), F.lit(False).alias("last"))
    names = lambda block: sorted(map(tuple, named_prefixes(turns, block).collect()))
    assert names(7) == names(1 << 16) == names(1)


def test_ends_of_one_node_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    rows = spark.range(1000).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    top, leaf = prefix_trie(rows.repartition(5)).orderBy("depth").collect()
    assert leaf["ends_sha256"] == hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()
    assert (top["n_convs"], top["n_leaves"], leaf["saved_tokens"]) == (1000, 1, 999 * 4)


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
