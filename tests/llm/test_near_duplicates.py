import random

import numpy as np
import pytest
from tables import ODD_TEXTS, odd_documents

from tessella.llm import near_duplicates as N
from tessella.llm import ragged
from tessella.scale import cut

MASK = (1 << 64) - 1


def mix(x):
    return int(ragged.mix(np.array([x & MASK], np.uint64))[0])


def sequential(elements, m):
    """The plain one-element-at-a-time form with early stopping, on the same draws."""
    h = [MASK] * m
    for e in elements:
        perm = list(range(m))
        for rank in range(m):
            if max(h) < rank << 32:
                break
            draw = mix(e + ((rank + 1) * 0x9E3779B97F4A7C15))
            pick = rank + ((draw & 0xFFFFFFFF) * (m - rank) >> 32)
            target = perm[pick]
            h[target] = min(h[target], (rank << 32) | (draw >> 32))
            perm[pick], perm[rank] = perm[rank], target
    return h


def test_signatures_equal_the_sequential_form():
    random.seed(1)
    sets = [[random.getrandbits(64) for _ in range(n)] for n in (1, 3, 20, 200, 0, 700)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    flat = np.array([e for s in sets for e in s], np.uint64)
    got = N.super_minhash(flat, offsets, 16)
    for i, s in enumerate(sets):
        assert got[i].tolist() == sequential(s, 16)


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(5)
    n, common = 50, 44
    found = []
    for _ in range(400):
        c, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (common, n - common, n - common))
        s = N.super_minhash(np.concatenate([c, a, c, b]), np.array([0, n, 2 * n]))
        found.append((s[0] == s[1]).mean())
    true = common / (2 * n - common)
    assert abs(np.mean(found) - true) < 0.01
    assert np.std(found) < 0.9 * (true * (1 - true) / N.REGISTERS) ** 0.5


def brute(rows, words=4, percent=80):
    sets = [(i, N.exact_shingles(t or "", words)) for i, t in rows]
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, _ in sets:
        root[i] = i
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s) if i is not None else None, find(i)) for i, s in sets), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(
        ((r["doc_id"], r["n_shingles"] if r["doc_id"] is not None else None, r["component_id"]) for r in N.near_duplicates(df, **options).collect()),
        key=repr,
    )


def variants(seed, copies):
    """Originals, copies with a few words changed, chains of edits, exact copies."""
    random.seed(seed)
    lexicon = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(12):
        base = [random.choice(lexicon) for _ in range(random.choice([3, 8, 60, 150]))]
        chain = list(base)
        for c in range(copies):
            edited = list(chain if c % 2 else base)
            for _ in range(random.randint(0, 2)):
                edited[random.randrange(len(edited))] = random.choice(lexicon)
            if c % 2:
                chain = edited
            rows.append((i, " ".join(edited)))
            i += 1
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rows = variants(seed, 14) + [(5000, None), (5001, ""), (5002, " \n "), (5003, "one"), (5004, "ONE"), (5005, "É é")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, words=5) == brute(rows, 5)


def test_hot_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)  # many blocks per bucket
    random.seed(9)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(150)]
    for i in range(150, 330):  # around the threshold, so buckets hold several components
        edited = list(base)
        for _ in range(random.randint(1, 5)):
            edited[random.randrange(80)] = f"x{random.randrange(10)}"
        rows.append((i, " ".join(edited)))
    assert run(spark, rows) == brute(rows)


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001)]
    random.seed(2)
    random.shuffle(pairs)
    found = {r["row"]: r["component"] for r in N.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 1001: 1000, 1002: 1000}


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = run(spark, rows)
    assert got == brute(rows) and len({c for *_, c in got}) < len(rows)


def test_edges(spark):
    docs = odd_documents(spark)
    got = N.near_duplicates(docs).collect()
    assert len(got) == len(ODD_TEXTS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9]["component_id"] == 1 and not by_id[9]["kept"] and by_id[1]["kept"]
    assert by_id[None]["kept"] and by_id[None]["component_id"] is None
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["kept"] for i in (2, 3, 4))
    assert [r["component_id"] for r in got if r["doc_id"] == 7] == [7, 7]
    assert N.near_duplicates(docs.where("false")).count() == 0


def test_rounds_over_few_links_need_few_tasks(spark):
    """A shuffle of every step over all partitions filled the disk with small files."""
    plain = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    links = cut(spark.range(1, 300, 1, 1).selectExpr("id as a", "cast(floor(id / 3) as bigint) as b"))
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        got = {r["row"]: r["component"] for r in N.components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext._jsc.clearJobGroup()
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("rounds") for s in status.getJobInfo(j).stageIds}
    tasks = sum(i.numTasks for s in stages if (i := status.getStageInfo(s)))
    assert got == dict.fromkeys(range(1, 300), 0)
    assert tasks < 10 * 40
