import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import ODD_TEXTS, odd_documents

from tessella.llm import word_runs
from tessella.llm.queries import op13_word_runs
from tessella.llm.word_runs import find_runs, lyndon_array, runs_in_texts, runs_of

FOLDER = "/root/testdata/sf0.001"


def brute_lyndon(symbols, descending):
    s = [-x if descending else x for x in symbols]
    n = len(s)
    return [max(m for m in range(1, n - i + 1) if all(s[i : i + m] < s[i + k : i + m] for k in range(1, m))) for i in range(n)]


def brute_runs(words, min_length, min_periods):
    n, found = len(words), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            own = words[start : start + length]
            smaller = any(own[d:] == own[:-d] for d in range(1, q))
            if length >= max(min_length, min_periods * q) and not smaller:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def sample(rng, letters, n):
    out = []
    while len(out) < n:
        out += [rng.choice(letters) for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 2, 3, 5])
    return out[:n]


def test_lyndon_arrays_of_both_orders():
    rng = random.Random(1)
    for _ in range(400):
        s = sample(rng, range(rng.randint(1, 4)), rng.randint(0, 24))
        for descending in (False, True):
            assert lyndon_array(s, descending).tolist() == brute_lyndon(s, descending), s


@pytest.mark.parametrize("limits", [(2, 2), (6, 3), (24, 3), (5, 2)])
def test_runs_equal_brute_force(limits):
    rng = random.Random(limits[0])
    for _ in range(300):
        s = sample(rng, range(rng.randint(1, 4)), rng.randint(0, 70))
        assert list(map(tuple, runs_of(np.array(s, np.int64), *limits).tolist())) == brute_runs(s, *limits), s


@pytest.mark.parametrize("limits", [(2, 2), (6, 3), (24, 3), (30, 2)])
def test_stretches_lose_no_run(limits):
    rng = random.Random(7)
    for _ in range(60):
        texts = [[b"w%d" % x for x in sample(rng, range(rng.randint(1, 9)), rng.randint(0, 90))] for _ in range(4)]
        texts.insert(2, [])
        got = [list(map(tuple, r.tolist())) for r in runs_in_texts(texts, *limits)]
        assert got == [brute_runs(t, *limits) for t in texts]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words, 24, 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    collapsed = b" ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, milli, sha(lines.encode()), sha(collapsed), n)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = sorted(map(tuple, op13_word_runs(spark, FOLDER).collect()))
    short = {r["doc_id"]: r["text"] for r in docs.where("length(text) < 6000").collect()}
    assert len(got) == docs.count() and len(short) > 150
    got = [r for r in got if r[0] in short]
    assert got == sorted(expected(i, t) for i, t in short.items())
    assert sum(r[1] > 0 for r in got) > 5


def test_edges(spark):
    docs = odd_documents(spark)
    rows = find_runs(docs).collect()
    assert len(rows) == len(ODD_TEXTS)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["n_words"] == 0 and by_id[i]["runs"] == [] and by_id[i]["collapsed"] == "" for i in (2, 3, 4))
    [run] = by_id[6]["runs"]  # eight words, six thousand times
    assert (run["start"], run["length"], run["period"]) == (0, 48_000, 8)
    assert by_id[6]["collapsed"] == "the quick brown fox jumps over it again."
    assert find_runs(docs.where("false")).count() == 0


def test_very_different_lengths_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(word_runs, "GROUP_BYTES", 100)
    texts = ["a " * n for n in (0, 1, 23, 24, 500)] + ["x y z " * 8 + "q " + "x y z " * 8, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = [[tuple(r) for r in row["runs"]] for row in find_runs(docs).orderBy("doc_id").collect()]
    assert got == [brute_runs((t or "").split(), 24, 3) for t in texts]


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "b " * 30), (1, "b " * 30), (None, "b " * 30)], "doc_id long, text string")
    assert find_runs(docs.withColumn("runs", F.lit(1))).select("n_words").collect() == [(30,)] * 3
