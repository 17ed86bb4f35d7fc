import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import conflicts as CF
from tessella.operators import hybrid as HY
from tessella.operators import intake as IN
from tessella.operators import keyword as KW
from tessella.operators import vectors as VE

DOCS = [
    ("a", 0, "il mare calmo e blu", "s1"),
    ("b", 1, "la montagna alta e fredda", "s1"),
    ("c", 2, "mare mare in tempesta", "s2"),
    ("d", 3, "", "s2"),
    ("e", 4, "il mare calmo e blu", "s2"),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "id string, seq long, content string, shelf string")


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def brute_bm25(rows, query):
    bags = {r[0]: r[2].split() for r in rows if r[2].split()}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    out = {}
    for i, bag in bags.items():
        score = 0.0
        for term in query.split():
            df = sum(term in b for b in bags.values())
            tf = bag.count(term)
            if tf:
                score += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / mean))
        if score:
            out[i] = score
    return out


def test_bm25_against_brute_force(spark):
    queries = ["mare calmo", "mare mare", "fredda e", "nulla"]
    got = {}
    for r in KW.bm25(docs(spark), questions(spark, *queries), 10).collect():
        got.setdefault(r["qid"], {})[r["id"]] = r["score"]
    for qid, text in enumerate(queries):
        assert got.get(qid, {}) == pytest.approx(brute_bm25(DOCS, text))


def test_equal_texts_rank_by_order(spark):
    ranked = KW.bm25(docs(spark), questions(spark, "calmo"), 10).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == ["a", "e"]


def test_shelves_have_their_own_statistics(spark):
    got = KW.bm25(docs(spark), questions(spark, "mare"), 10, by_shelf=True).collect()
    for shelf in ("s1", "s2"):
        want = brute_bm25([d for d in DOCS if d[3] == shelf], "mare")
        assert {r["id"]: r["score"] for r in got if r["shelf"] == shelf} == pytest.approx(want)


def test_persisted_index_gives_the_same_hits(spark):
    path = tempfile.mkdtemp(prefix="tessella-index-")
    KW.write_index(docs(spark), path, by_shelf=False)
    q = questions(spark, "mare calmo", "alta")
    a = KW.search_index(spark, path, q, 3).select("qid", "id", "rank", F.round("score", 9).alias("s"))
    b = KW.bm25(docs(spark), q, 3).select("qid", "id", "rank", F.round("score", 9).alias("s"))
    assert sorted(a.collect()) == sorted(b.collect())


def vectors(spark, n, dim=8, seed=1, prefix="v"):
    rng = np.random.RandomState(seed)
    raw = rng.randn(n, dim)
    raw /= np.linalg.norm(raw, axis=1, keepdims=True)
    rows = [(f"{prefix}{i:03d}", i, raw[i].tolist()) for i in range(n)]
    return raw, spark.createDataFrame(rows, "id string, seq long, vec array<double>")


def test_nearest_both_paths(spark):
    m, v = vectors(spark, 120)
    qm, q = vectors(spark, 15, seed=2)
    q = q.select(F.col("seq").alias("qid"), "vec")
    want = {i: [f"v{j:03d}" for j in np.argsort(-(m @ qm[i]), kind="stable")[:4]] for i in range(15)}
    direct = VE.nearest(v, q, 4)
    blocks = VE.top_per_group(VE._blockwise(v, q, 4, rows=6), ["qid"], [F.col("score").desc(), F.col("seq").asc()], 4)
    for hits in (direct, blocks):
        got = {}
        for r in hits.orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        assert got == want


def test_fallback_vectors_are_reproducible_and_distinct(spark):
    df = spark.createDataFrame([("x", "testo"), ("y", "altro")], "id string, content string")
    a, b = VE.fallback_embedder("index"), VE.fallback_embedder("conflict")
    one = df.select(a("content").alias("v"), b("content").alias("w")).first()
    seed = sum(ord(c) * (i + 1) for i, c in enumerate("testo")) % (2**31 - 1)
    want = np.random.RandomState(seed).randn(384)
    assert np.allclose(one["v"], want / np.linalg.norm(want))
    assert not np.allclose(one["v"], one["w"]) and len(one["w"]) == 384


def test_min_max_edges(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (2, "a", 1.0), (2, "b", 3.0), (2, "c", 2.0)], "qid long, id string, score double")
    got = {(r["qid"], r["id"]): r["norm"] for r in HY.min_max(df, ["qid"]).collect()}
    assert got == {(1, "a"): 1.0, (2, "a"): 0.0, (2, "b"): 1.0, (2, "c"): 0.5}


def test_fusion_drops_only_zero_rows(spark):
    kw = spark.createDataFrame([(1, "a", 0, 2.0), (1, "b", 1, 1.0)], "qid long, id string, seq long, score double")
    em = spark.createDataFrame([(1, "a", 0, 0.9), (1, "c", 2, 0.1)], "qid long, id string, seq long, score double")
    got = {r["id"]: r["score"] for r in HY.fuse(kw, em, 5).collect()}
    assert got == {"a": pytest.approx(1.0)}


def test_intake_similarity_and_vectors(spark):
    q = questions(spark, "mare calmo blu forte")
    got = {r["id"]: r["sim"] for r in IN.word_similarities(docs(spark), q).collect()}
    assert got == {"a": pytest.approx(0.75), "e": pytest.approx(0.75), "c": pytest.approx(1 / 3)}
    v = spark.createDataFrame([("b", 1, [1.0, 0.0]), ("a", 0, [0.0, 1.0])], "id string, seq long, vec array<double>")
    qv = spark.createDataFrame([(0, [0.95, 0.3])], "qid long, vec array<double>")
    ranked = IN.candidates(docs(spark), q, 2, vectors=v, query_vectors=qv).orderBy("rank").collect()
    assert [(r["id"], round(r["sim"], 2)) for r in ranked] == [("b", 0.95), ("a", 0.75)]


def test_substring_search_both_paths(spark, monkeypatch):
    texts = docs(spark).select("content", F.lit("topic one").alias("topic"), F.array(F.lit("tag")).alias("tags"))
    needles = spark.createDataFrame([("mare c",), ("zzz",), ("pic o",), ("tag",), ("blu",)], "aspect string")
    want = {"mare c", "pic o", "tag", "blu"}
    assert {r[0] for r in IN.find_substrings(texts, needles).collect()} == want
    monkeypatch.setattr(IN, "NEEDLES_PER_PASS", 2)
    assert {r[0] for r in IN.find_substrings(texts, needles).collect()} == want


ANTONYM_TEXTS = ["increase buy start up", "decrease sell stop down", "plain words", "increase sell", "up down"]


def conflict_rows(spark, n=90):
    rng = np.random.RandomState(7)
    base = rng.randn(6, 5)
    rows = []
    for i in range(n):
        v = base[i % 6] + rng.randn(5) * (0.0 if i % 3 == 0 else 0.35)
        v = v / np.linalg.norm(v)
        rows.append((f"r{i:02d}", v.tolist(), ANTONYM_TEXTS[i % len(ANTONYM_TEXTS)]))
    df = spark.createDataFrame(rows, "id string, vec array<double>, content string")
    return rows, CF.conflict_features(df, df)


def brute_conflicts(rows, probes, t, check_at=0.85):
    from tessella.functions.lexicon import ANTONYMS

    out = {}
    for i, v, text in probes:
        n, best, worst, opposed = 0, -9.0, 0.0, 0
        for j, w, other in rows:
            if i == j:
                continue
            s = float(np.dot(v, w))
            if s >= t:
                a, b = set(text.split()), set(other.split())
                c = min(0.25 * sum((x in a and y in b) or (y in a and x in b) for x, y in ANTONYMS), 0.8) if s >= check_at else 0.0
                n, best, worst, opposed = n + 1, max(best, s), max(worst, c), opposed + (c > 0.5)
        if n:
            out[i] = (n, round(best, 9), round(worst, 9), opposed)
    return out


def collected(df):
    return {
        r["id"]: (r["n_conflicts"], round(r["max_similarity"], 9), round(r["max_contradiction"], 9), r["n_opposed"])
        for r in df.collect()
    }


@pytest.mark.parametrize("threshold", [0.85, 0.95, 0.3])
def test_archive_scan_against_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(CF, "BLOCK_ROWS", 7)
    rows, features = conflict_rows(spark)
    assert collected(CF.scan_archive(features, threshold)) == brute_conflicts(rows, rows, threshold)


def test_probe_scan_both_paths(spark, monkeypatch):
    rows, features = conflict_rows(spark, 40)
    probes = features.where("id < 'r10'")
    want = brute_conflicts(rows, rows[:10], 0.85)
    assert collected(CF.scan_probes(probes, features)) == want
    monkeypatch.setattr(CF, "PROBE_ROWS", 3)
    assert collected(CF.scan_probes(probes, features)) == want


def test_probe_blocks_copy_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(CF, "PROBE_ROWS", 4)
    rows, features = conflict_rows(spark, 40)
    out = CF.scan_probes(features, features, 0.3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "vec" not in plan
    assert collected(out) == brute_conflicts(rows, rows, 0.3)
    huge = features.withColumn("vec", F.transform("vec", lambda x: x * 1e25))
    want = {k: v[0] for k, v in brute_conflicts(rows, rows, 0.3).items()}
    assert {r["id"]: r["n_conflicts"] for r in CF.scan_probes(huge, huge, 0.3e50).collect()} == want


def test_conflict_entries(spark):
    rows, features = conflict_rows(spark, 24)
    contents = spark.createDataFrame([(i, t) for i, _, t in rows], "id string, content string")
    got = CF.conflict_entries(features.where("id = 'r00'"), features, contents).collect()
    assert len(got) == brute_conflicts(rows, rows[:1], 0.85)["r00"][0]
    assert all((r["method"] == "nli_contradiction") == (r["contradiction"] > 0.5) for r in got)


def test_hot_copies_do_not_multiply(spark):
    random.seed(1)
    rows = [(f"h{i:03d}", [1.0, 0.0], "up") for i in range(60)] + [("x", [0.0, 1.0], "down")]
    df = spark.createDataFrame(rows, "id string, vec array<double>, content string")
    got = collected(CF.scan_archive(CF.conflict_features(df, df)))
    assert len(got) == 60 and set(got.values()) == {(59, 1.0, 0.0, 0)}


@pytest.mark.parametrize("threshold", [0.85, 0.3])
def test_archive_scan_copies_each_vector_to_few_blocks(spark, monkeypatch, threshold):
    """Sides of one vector are members of its group, and blocks fill before they become more."""
    for name, value in {"EVEN_ROWS": 4, "EVEN_BLOCKS": 3, "MEMBERS": 2, "MEMBER_PAIRS": 5, "TILE_ROWS": 4, "TILE_COLUMNS": 6, "PAIRS": 3}.items():
        monkeypatch.setattr(CF, name, value)
    met = []
    monkeypatch.setattr(CF.F, "explode", lambda c, explode=F.explode: met.append(c) or explode(c))
    rows, features = conflict_rows(spark)
    got = CF.scan_archive(features, threshold)
    assert collected(got) == brute_conflicts(rows, rows, threshold)
    assert len(met) == 2 and "sequence(0, 2)" in str(met[0])  # three blocks, however many rows


def test_probes_skip_excluded_rows(spark, monkeypatch):
    rows, features = conflict_rows(spark, 30)
    probes = features.where("id < 'r06'").withColumn("exclude", F.array(F.lit("r03"), F.lit("r12")))
    stored = [r for r in rows if r[0] not in ("r03", "r12")]
    want = brute_conflicts(stored, rows[:6], 0.85)
    assert collected(CF.scan_probes(probes, features)) == want
    monkeypatch.setattr(CF, "PROBE_ROWS", 2)
    assert collected(CF.scan_probes(probes, features)) == want


def test_proposals_do_not_conflict_with_their_sources(spark):
    f = spark.createDataFrame([("s", "same text"), ("t", "same text")], "id string, content string")
    a = spark.createDataFrame([("p", ["s"], "same text"), ("q", ["s", "t"], "same text")], "id string, sources array<string>, proposed_content string")
    got = collected(CF.proposal_conflicts(a, f, VE.fallback_embedder("conflict")))
    assert set(got) == {"p"} and got["p"][0] == 1


def test_answer_with_warnings(spark):
    df = spark.createDataFrame([("ans", 0.874, ["w"]), ("ans", 0.5, [])], "a string, s double, w array<string>")
    line = HY.conflict_warning(F.lit("x"), F.lit("y"), F.col("s"), F.lit("embedding_similarity"))
    got = df.select(line.alias("l"), HY.with_warnings(F.col("a"), F.col("w")).alias("t")).collect()
    assert got[0]["l"] == "⚠ Conflict detected: x vs y (similarity: 87%, method: embedding_similarity)"
    assert [r["t"] for r in got] == ["ans\n\n--- Conflict Warnings ---\nw", "ans"]


def test_large_batches_give_the_same_rows(spark, monkeypatch):
    """The joined form for batches too large to hold agrees with scores inside the row."""
    from tessella.operators import inrow, intake, keyword

    texts = ["tide and moon", "moon moon sun", "the sea the tide", "", "sun"]
    rows = spark.createDataFrame(
        [(f"r{i}", i, "ab"[i % 2], t, 0.99) for i, t in enumerate(texts * 4)],
        "id string, seq long, shelf string, content string, quality double",
    ).withColumn("provenance", F.struct(F.lit("inherited").alias("final_source")))
    asked = spark.createDataFrame([(1, "moon tide"), (2, "the sun the"), (3, "nothing")], "qid long, text string")

    def results():
        found = [keyword.bm25(rows, asked, 3), keyword.bm25(rows, asked, 2, by_shelf=True), intake.candidates(rows, asked, 4)]
        lists = [
            sorted((r["qid"], r["rank"], r["id"], round(r[value], 9)) for r in df.collect())
            for df, value in zip(found, ("score", "score", "sim"), strict=True)
        ]
        return lists, sorted(map(tuple, intake.certified_count(rows, asked).collect()))

    inside = results()
    assert len(inside[0][0]) == 6 and dict(inside[1])[3] == 0
    monkeypatch.setattr(inrow, "BROADCAST_ROWS", 2)
    assert results() == inside
    monkeypatch.undo()
    monkeypatch.setattr(inrow, "CELLS", 8)  # many blocks of rows
    assert results() == inside


def test_words_of_rows_stay_in_arrow(spark, monkeypatch):
    """Rows are scored a few words at a time; a word costs no Python object, a shelf no dense table."""
    import pyarrow as pa

    from tessella.operators import inrow

    asked = spark.createDataFrame([("s", f"w{i}", i % 7, 1.0, 2.0) for i in range(900)], "shelf string, term string, qid long, w double, mean_size double")
    weights = inrow.bounded_weights(asked)
    assert sum(x.nbytes for x in (weights["s"].start, weights["s"].query, weights["s"].weight)) < 900 * 7 * 8
    monkeypatch.setattr(inrow, "WORDS", 10)
    toks = [["w1", "w2", "x"], None, ["w8", "w8"], [], ["w3"] * 40, ["w1"] * 8]
    batch = pa.RecordBatch.from_pydict({"shelf": ["s", "s", "s", "t", "s", "s"], "toks": toks, "size": [3, 0, 2, 0, 40, 8]})
    parts = [part for _, _, part in inrow._parts(iter([batch]), weights)]
    assert [p.num_rows for p in parts] == [3, 1, 1]
    table = np.vstack([t for p in parts for _, t in inrow._scores(p, weights["s"], lambda times, size, own: times / size)])
    want = np.zeros((5, 7))
    want[0, 1], want[0, 2], want[2, 1], want[3, 3], want[4, 1] = 1 / 3, 1 / 3, 1.0, 1.0, 1.0
    assert np.allclose(table, want)
