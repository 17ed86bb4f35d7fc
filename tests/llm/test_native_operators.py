import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import ODD_TEXTS, odd_documents, odd_labels

from tessella.llm import fingerprints, mixing, quality
from tessella.llm.fingerprints import fingerprint_pairs
from tessella.llm.mixing import mix_documents
from tessella.llm.quality import assess_quality

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def jaccard(a, b):
    a, b = (collections.Counter(WORD.findall(t)) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def edited(text, following):
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def check_pairs(rows, got, tolerance):
    texts = [t or "" for _, t in rows]
    gaps = []
    for n, ((i, _), r) in enumerate(zip(rows, got)):
        following = texts[(n + 1) % len(texts)]
        other = edited(texts[n], following)
        assert r["doc_id"] == i and r["n_chars"] == len(texts[n])
        assert r["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        gaps += [r["near_edited"] - jaccard(texts[n], other), r["near_next"] - jaccard(texts[n], following)]
    assert abs(np.mean(gaps)) < tolerance / 4 and np.sqrt(np.mean(np.square(gaps))) < tolerance


def test_fingerprints_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = fingerprint_pairs(docs).orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    check_pairs(rows, got, 0.09)
    by_text = collections.defaultdict(set)
    for (_, t), r in zip(rows, got):
        by_text[t].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprints_shuffle_texts_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # shared shuffles show in the first plan
    try:
        found = fingerprint_pairs(spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string"))
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert any("ReusedExchange" in line and "_text#" in line and "_ghost#" in line for line in plan)


def test_fingerprints_follow_a_missing_id_with_the_least_one(spark):
    docs = spark.createDataFrame([(None, "aaaa bbbb"), (-(2**63), "cccc dddd"), (None, "eeee ffff")], "doc_id long, text string")
    got = fingerprint_pairs(docs).collect()
    nulls = {r["edited_sha256"] for r in got if r["doc_id"] is None}
    least = [r["edited_sha256"] for r in got if r["doc_id"] is not None]
    sha = lambda *pair: hashlib.sha256(edited(*pair).encode()).hexdigest()
    a, c, e = "aaaa bbbb", "cccc dddd", "eeee ffff"
    assert (nulls, least) in (({sha(a, e), sha(e, c)}, [sha(c, a)]), ({sha(e, a), sha(a, c)}, [sha(c, e)]))


def test_fingerprint_edges(spark):
    docs = odd_documents(spark)
    got = fingerprint_pairs(docs).collect()
    assert len(got) == len(ODD_TEXTS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["fingerprint"] == by_id[3]["fingerprint"] == by_id[4]["fingerprint"]
    assert by_id[2]["near_next"] == by_id[2]["near_edited"] == 1.0 and by_id[1]["near_next"] == 0.0
    assert by_id[1]["fingerprint"] == by_id[9]["fingerprint"]
    unique = [r for r in ODD_TEXTS if r[0] is not None and r[0] != 7]
    rows = sorted((r[0], r[1]) for r in unique)
    some = spark.createDataFrame(unique, "doc_id long, text string, lang string, source string")
    check_pairs(rows, fingerprint_pairs(some).orderBy("doc_id").collect(), 0.2)
    assert fingerprint_pairs(docs.where("false")).count() == 0
    one = fingerprint_pairs(docs.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(
        edited(ODD_TEXTS[0][1], ODD_TEXTS[0][1]).encode()
    ).hexdigest()


def test_weights_count(spark):
    """Samples of weighted terms collide as the generalised Jaccard similarity."""
    texts = ["a " * 30 + "b " * 10, "a " * 10 + "b " * 10 + "c " * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = fingerprint_pairs(docs, samples=256).orderBy("doc_id").first()["near_next"]
    assert abs(near - jaccard(*texts)) < 0.12


def test_long_texts_are_as_alike_as_their_words(spark):
    """Neighbours of many distinct words: the likeness stays within its standard error."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    longest = docs.orderBy(F.char_length("text").desc(), "doc_id").limit(10)
    rows = [(n, r["text"]) for n, r in enumerate(longest.collect())]
    random.seed(12)
    names = [f"name{i}" for i in range(60_000)]
    rows += [(n, " ".join(random.sample(names, 20_000))) for n in range(10, 14)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint_pairs(some, samples=256).orderBy("doc_id").collect()
    texts = [t for _, t in rows]
    for n, r in enumerate(got):
        for near, other in (
            (r["near_next"], texts[(n + 1) % len(texts)]),
            (r["near_edited"], edited(texts[n], texts[(n + 1) % len(texts)])),
        ):
            true = jaccard(texts[n], other)
            assert abs(near - true) <= 3 * np.sqrt(max(true * (1 - true), 1 / 256) / 256)


def test_mixing_meets_its_targets(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = mix_documents(docs, labels).toPandas()
    assert len(got) == docs.count() and (got["rate"] >= 0).all()
    parts = got[["p_low", "p_plain", "p_toxic"]]
    assert np.allclose(parts.sum(axis=1), 1)
    total = got["n_tokens"].sum()
    for domain, share in mixing.TARGETS.items():
        assert abs((got["rate"] * got["n_tokens"] * got[f"p_{domain}"]).sum() / total - share) < 1e-6
    marked = got.merge(labels.toPandas(), on="doc_id")
    low = marked[marked["quality"] == 0]["p_low"].mean()
    assert low > 0.6 > marked[marked["quality"] == 1]["p_low"].mean() + 0.4


def test_small_posteriors_count(spark):
    """Totals under the unrounded posteriors meet the targets, however small each one is."""
    rng = np.random.default_rng(6)
    names = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(names, 2)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 12 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    got = mix_documents(docs, labels, targets={"plain": 0.99, "toxic": 0.01}).orderBy("doc_id").toPandas()
    marked = docs.withColumn("domain", F.when(F.col("doc_id") % 12 == 0, "toxic").otherwise("plain"))
    prior, terms = mixing.fit_domains(marked, ["plain", "toxic"])
    at = docs.select(F.transform(mixing.words_of(F.col("text")), mixing.term_of).alias("t"))
    odds = [prior[1] - prior[0] + (terms[1] - terms[0])[r["t"]].sum() / np.sqrt(2) for r in at.collect()]
    want = 1 / (1 + np.exp(-np.array(odds)))
    assert 0 < np.median(want) < 1 / 64
    assert np.allclose(got["p_toxic"], want, atol=1e-12)
    assert abs((got["rate"] * want).mean() - 0.01) < 1e-6


def test_rates_out_of_reach_settle_or_fail(spark, monkeypatch):
    rows = spark.createDataFrame([(31.68, 0.32, 10)] * 5, "_q0 double, _q1 double, _tokens long")
    got = [r["rate"] for r in mixing.fit_rates(rows, np.array([0.95, 0.05])).collect()]
    best = (0.95 * 0.99 + 0.05 * 0.01) / (0.99**2 + 0.01**2)
    assert np.allclose(got, best, atol=1e-6)
    monkeypatch.setattr(mixing, "LIMIT", 1, raising=False)
    with pytest.raises(RuntimeError):
        mixing.fit_rates(rows, np.array([0.5, 0.5]))


def brute_rates(q, tokens, targets, steps=20000):
    """Plain projected gradient over all documents."""
    p, total = q, tokens.sum()
    x = np.ones(len(p))
    for _ in range(steps):
        residual = (x * tokens) @ p / total - targets
        x = np.maximum(x - p @ residual, 0)
    return x, np.abs((x * tokens) @ p / total - targets).max()


def test_rates_minimise_like_plain_gradient(spark):
    random.seed(4)
    rows = []
    for _ in range(200):
        a = random.randint(0, mixing.GRID)
        b = random.randint(0, mixing.GRID - a)
        rows.append((a, b, mixing.GRID - a - b, random.randint(1, 500)))
    grid = spark.createDataFrame(rows, "_q0 long, _q1 long, _q2 long, _tokens long")
    for targets in (np.array([0.2, 0.3, 0.5]), np.array([0.9, 0.06, 0.04])):
        got = mixing.fit_rates(grid, targets).toPandas()
        q, tokens = got[["_q0", "_q1", "_q2"]].to_numpy() / mixing.GRID, got["_tokens"].to_numpy(float)
        residual = np.abs((got["rate"].to_numpy() * tokens) @ q / tokens.sum() - targets).max()
        _, plain = brute_rates(q, tokens, targets)
        assert residual <= plain + 1e-4 and (got["rate"] >= 0).all()


def test_mixing_edges(spark):
    docs, labels = odd_documents(spark), odd_labels(spark)
    got = mix_documents(docs, labels, keep=("text", "key")).toPandas()
    assert len(got) == len(ODD_TEXTS) and got["rate"].notna().all() and (got["key"] == -1).all()
    assert (got[got["doc_id"].isin([2, 3, 4])]["n_tokens"] == 0).all()
    none = mix_documents(docs, labels.where("false")).toPandas()
    assert (none["rate"] == 1).all() and (none["p_plain"] == 0).all()
    assert mix_documents(docs.where("false"), labels).count() == 0
    assert mix_documents(docs, labels.where("doc_id = 1")).where("rate is null").count() == 0
    times = docs.withColumn("rate", F.lit(1.25)).select(mixing.copies("rate", "doc_id").alias("n"))
    assert {r["n"] for r in times.collect()} <= {1, 2}


def brute_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(s) for s in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_counts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    got = assess_quality(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert 0.75 < np.mean([r["kept"] for r in got]) < 0.99


def test_outliers_are_rejected_and_the_rest_kept(spark):
    random.seed(8)
    words = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(400):
        text = " ".join(random.choice(words) for _ in range(random.randint(30, 400)))
        rows.append((i, text + (" ### $$$ ***" * 40 if i % 20 == 0 else ""), "en", f"s{i % 2}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in assess_quality(docs).where("kept").collect()}
    assert kept == {i for i in range(400) if i % 20}


def test_an_outlier_in_each_single_dimension_is_rejected(spark):
    random.seed(3)
    fresh = (f"word{i}" for i in range(10**6, 10**7))

    def lines(n):
        return [" ".join(next(fresh) for _ in range(3)) for _ in range(n)]

    rows = ["\n".join(lines(random.randint(150, 300))) for _ in range(300)]
    usual = lines(225)
    odd = [
        "\n".join(lines(10000)),
        "\n".join(line.replace("word", "longerword") for line in lines(225)),
        "\n".join([*usual[:-1], usual[-1] + "#" * 50]),
        "\n".join(line for line in lines(112) for _ in range(2)),  # no window of words comes twice
        "\n".join([*usual, " ".join(usual[:20])]),  # 120 of 735 words in windows that come twice
    ]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(rows + odd)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in assess_quality(docs).collect()}
    assert not any(got[i]["base_failed"] for i in got)
    assert [got[300 + i]["kept"] for i in range(len(odd))] == [False] * len(odd)
    assert np.mean([got[i]["kept"] for i in range(300)]) > 0.98


def test_quality_edges(spark):
    docs = odd_documents(spark)
    got = assess_quality(docs).collect()
    assert len(got) == len(ODD_TEXTS)
    by_id = {r["doc_id"]: r for r in got}
    texts = {i: t or "" for i, t, *_ in ODD_TEXTS}
    for i, r in by_id.items():
        assert tuple(r[c] for c in COUNTS) == brute_counts(texts[i])
    assert by_id[2]["base_failed"] and by_id[6]["base_failed"] and by_id[1]["kept"] and by_id[None]["kept"]
    assert assess_quality(docs.where("false")).count() == 0
    odd = ["x\n x\nx\r\nx\nx", "a b c d e a b c d e", "a " * 9, "a a a a a a", "\x0b\x0c a\x1fb", "\n\n\n"]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string")
    for r in assess_quality(df).collect():
        assert tuple(r[c] for c in COUNTS) == brute_counts(odd[r["doc_id"]])


@pytest.mark.parametrize("make", [
    lambda d, l: fingerprint_pairs(d), lambda d, l: assess_quality(d), lambda d, l: mix_documents(d, l)
])
def test_plans_hold_no_python(spark, make):
    docs, labels = odd_documents(spark), odd_labels(spark)
    plan = make(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_determinant_root(spark):
    """The triangular root solves what a dense inverse solves."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, quality.DIMENSIONS)) @ rng.normal(size=(quality.DIMENSIONS,) * 2)
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], ["_group", *quality.X])
    sums = df.groupBy("_group").agg(
        F.count("*").alias("_n"),
        *[F.lit(0.0).alias(f"_c{i}") for i in range(quality.DIMENSIONS)],
        *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(quality.X)],
        *[F.sum(F.col(quality.X[i]) * F.col(quality.X[j])).alias(f"_p{i}{j}") for i, j in quality.PAIRS],
    )
    got = df.join(quality.rooted(sums), "_group").select(*quality.X, quality.distance().alias("d")).toPandas()
    cov = np.cov(x.T, bias=True) + np.diag(np.square(quality.FLOORS))
    gap = got[quality.X].to_numpy() - x.mean(axis=0)
    assert np.allclose(got["d"], np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    assert fingerprints.SAMPLES % 4 == 0
