import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from tables import ODD_TEXTS, odd_documents, odd_labels

from tessella.llm import ragged, toxicity
from tessella.llm.piece_sampling import Sampler, decode, encode_samples
from tessella.llm.queries import tokenizer_file
from tessella.llm.toxicity import ClassModels, parted, score_toxicity, sequence_counts

MODEL = tokenizer_file("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.01"


def seeds(n):
    return ragged.mix(np.arange(n).astype(np.uint64))


def split(ids, offsets):
    return [tuple(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]


def segmentations(text):
    """All segmentations with their probability, by enumeration."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    weights = {
        model.id_to_piece(i): (i, -math.log((-s if 0 <= -s <= 32000 else 0.0) + 2.0))
        for i in range(259, 32000)
        for s in [model.get_score(i)]
    }
    text = "▁" + text.replace(" ", "▁")

    def from_(i):
        if i == len(text):
            yield (), 0.0
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in weights:
                piece, weight = weights[text[i:j]]
                for rest, w in from_(j):
                    yield (piece, *rest), weight + w

    found = list(from_(0))
    total = math.log(sum(math.exp(w) for _, w in found))
    return {s: math.exp(w - total) for s, w in found}


def test_samples_without_replacement_follow_the_distribution():
    sure = segmentations("thaten")
    n = 20000
    results, bound = Sampler(MODEL, 1.0).samples(["thaten"] * n, seeds(n), 3)
    drawn = [split(ids, offsets) for _, ids, offsets, _, _ in results]
    for (has, _, _, log_prob, value), paths in zip(results, drawn):
        assert len(has) == n
        assert np.allclose(log_prob, [math.log(sure[p]) for p in paths])
    assert all(len(set(p)) == 3 for p in zip(*drawn))
    assert all(a >= b for a, b in itertools.pairwise(np.mean(r[4]) for r in results))
    top = sorted(sure, key=sure.get)[::-1][:3]
    counts = Counter(zip(*drawn))
    for a, b, c in itertools.permutations(top):
        p = sure[a] * sure[b] / (1 - sure[a]) * sure[c] / (1 - sure[a] - sure[b])
        assert abs(counts[a, b, c] / n - p) < 4 * math.sqrt(p / n) + 1e-4
    weight = np.zeros(n)
    for has, _, _, log_prob, _ in results:
        weight[has] += np.exp(log_prob) / -np.expm1(-np.exp(log_prob - bound[has]))
    assert abs(weight.mean() - 1) < 0.02  # inverse inclusion weights are unbiased


def test_all_segmentations_when_k_is_large():
    sure = segmentations("at")
    results, bound = Sampler(MODEL, 1.0).samples(["at"] * 50, seeds(50), len(sure) + 3)
    assert len(results) == len(sure) and np.isneginf(bound).all()
    got = [split(ids, offsets) for _, ids, offsets, _, _ in results]
    assert all(set(paths) == set(sure) for paths in zip(*got))


def test_samples_do_not_depend_on_the_batch():
    texts = ["The quick brown fox", "", "日本語😀\n x", "  a  b ", "thaten thaten"]
    sampler = Sampler(MODEL, 1.0)
    together, _ = sampler.samples(texts, seeds(5), 2)
    for i in range(5):
        alone, _ = sampler.samples([texts[i]], seeds(5)[i : i + 1], 2)
        for (has, ids, offsets, *_), (_, one, _, *_) in zip(together, alone):
            at = has.tolist().index(i)
            assert ids[offsets[at] : offsets[at + 1]].tolist() == one.tolist()


def test_round_trip(spark):
    docs = odd_documents(spark)
    out = decode(encode_samples(docs, MODEL, k=2, keep=("text",)), MODEL).collect()
    for r in out:
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
        assert (r["log_inclusion"] <= 0) and r["sample"] in (1, 2)
    by_id = defaultdict(list)
    for r in out:
        by_id[r["doc_id"]].append(r)
    for i in (2, 3):  # nothing to segment
        assert [list(r["ids"]) for r in by_id[i]] == [[]] and by_id[i][0]["log_inclusion"] == 0
    assert tuple(by_id[1][0]["ids"]) != tuple(by_id[1][1]["ids"])
    assert sorted(map(str, (r["ids"] for r in by_id[7])))[0::2] == sorted(map(str, (r["ids"] for r in by_id[7])))[1::2]
    assert encode_samples(docs.where("false"), MODEL).count() == 0


def test_round_trip_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    out = decode(encode_samples(docs, MODEL, k=2, keep=("text",)), MODEL)
    assert out.where("decoded = text").count() == out.count() == 2 * docs.count()
    twice = [
        encode_samples(d, MODEL).agg(F.sum(F.xxhash64("doc_id", "sample", "ids").cast("decimal(38,0)"))).first()[0]
        for d in (docs, docs.repartition(7, "text"))
    ]
    assert twice[0] == twice[1]


class BruteModel:
    """The same interpolated models with dictionaries of tuples."""

    def __init__(self, texts, labels):
        n_max, shared = toxicity.ORDER, toxicity.SHARED_ORDER
        raw = [defaultdict(lambda: [0, 0]) for _ in range(n_max + 1)]
        for text, label in zip(texts, labels):
            for word in self.words(text):
                line = ["^"] * n_max + list(word) + ["$"]
                for t in range(n_max, len(line)):
                    for n in range(1, n_max + 1):
                        raw[n][tuple(line[t - n + 1 : t + 1])][0 if label else 1] += 1
        self.counts = []
        for n in range(1, n_max + 1):
            level = {}
            for gram, pair in raw[n].items():
                used = [sum(pair)] * 2 if n <= shared else list(pair)
                if n < n_max:
                    longer = [p for g, p in raw[n + 1].items() if g[1:] == gram]
                    if n + 1 <= shared:
                        longer = [[sum(p)] * 2 for p in longer]
                    seen = [[p[k] > 0 for p in longer] for k in (0, 1)]
                    before = [sum(s) for s in seen]
                    if n <= shared:
                        before = [sum(any(p) for p in longer)] * 2
                    used = [b if b > 1 else u for b, u in zip(before, used)]
                level[gram] = used
            self.counts.append(level)
        self.alphabet = len(self.counts[0]) + 1

    @staticmethod
    def words(text):
        return "".join(c if c.isalpha() else " " for c in text.lower()).split()

    def difference(self, word):
        n_max, d = toxicity.ORDER, toxicity.DISCOUNT
        line = ["^"] * n_max + list(word) + ["$"]
        total = 0.0
        for t in range(n_max, len(line)):
            p = [1 / self.alphabet] * 2
            for n in range(1, n_max + 1):
                level = self.counts[n - 1]
                gram = tuple(line[t - n + 1 : t + 1])
                followers = [c for g, c in level.items() if g[:-1] == gram[:-1]]
                for k in (0, 1):
                    all_ = sum(c[k] for c in followers)
                    if all_:
                        freed = sum(min(c[k], d) for c in followers)
                        p[k] = max(level.get(gram, (0, 0))[k] - d, 0) / all_ + freed / all_ * p[k]
            total += math.log(p[0]) - math.log(p[1])
        return math.copysign(max(abs(total) - toxicity.NOISE, 0), total)


def test_models_equal_brute_force():
    texts = ["you scum, you Idiot", "the cat sat on the mat", "idiots idle", "sat on that cat", "scum"]
    labels = [1, 0, 1, 0, 1]
    frame = sequence_counts(pd.DataFrame({"text": texts, "toxic": labels}))
    model = ClassModels.fit(frame.groupby(["n", "h", "context", "suffix"], as_index=False).sum())
    brute = BruteModel(texts, labels)
    assert model.alphabet == brute.alphabet
    words = ["scum", "idiot", "cat", "that", "xyz", "scums", "the"]
    codes, offsets = ragged.flatten(words)
    got = model.word_differences(codes, offsets[:-1], offsets[1:])
    assert np.allclose(got, [brute.difference(w) for w in words], atol=1e-4)


def test_toxicity_of_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    # even these tables mark few texts as toxic, so many expressions are never learned
    more = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    found = score_toxicity(*more).join(more[1], "doc_id").where("held_out").toPandas()
    toxic, clean = found[found["toxic"] == 1], found[found["toxic"] == 0]
    assert toxic["predicted"].mean() > 0.4 and clean["predicted"].mean() < 0.01
    small = score_toxicity(docs, labels)
    assert small.count() == docs.count() and small.where("score < 0 or score > 1 or score is null").count() == 0


def test_every_labelled_text_counts_or_calibrates(spark):
    rows = [(f"nice word{i} here", 0) for i in range(60)] + [("bad one", 1), ("bad two", 1), ("bad three", 1)]
    counts, calibrating = parted(spark.createDataFrame(rows, "text string, toxic int"))
    held = {r["text"] for r in calibrating.collect()}
    counted = [(t, k) for t, k in rows if t not in held]
    ends = counts.where("n = 5").agg(F.sum("toxic"), F.sum("ordinary")).first()
    symbols = [sum(len(w) + 1 for t, k in counted if k == kind for w in re.findall("[a-z]+", t)) for kind in (1, 0)]
    assert list(ends) == symbols and 0 < len(held) < len(rows)


def test_toxicity_edges(spark):
    docs, labels = odd_documents(spark), odd_labels(spark)
    got = score_toxicity(docs, labels).toPandas()
    assert len(got) == len(ODD_TEXTS) and got["score"].between(0, 1).all()
    empty = got[got["doc_id"].isin([2, 3, 4, 5])]["score"]
    assert empty.nunique() == 1
    same = got[got["doc_id"].isin([1, 9])]["score"]
    assert same.nunique() == 1
    assert not got[got["doc_id"].isna()]["held_out"].any()
    assert score_toxicity(docs.where("false"), labels).count() == 0
    blank = score_toxicity(docs, labels.where("false")).toPandas()
    assert (blank["score"] == 0.5).all()


def test_every_sequence_counts_beyond_the_broadcast(spark, monkeypatch):
    """Scores do not depend on how many sequences the driver may hold."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    odd = odd_documents(spark).select("doc_id", "text")
    docs = docs.select("doc_id", "text").where("doc_id % 3 = 0").unionByName(odd)
    want = score_toxicity(docs, labels).toPandas()
    for name in ("MAX_SEQUENCES", "BROADCAST_SEQUENCES"):
        monkeypatch.setattr(toxicity, name, 50, raising=False)
    got = score_toxicity(docs, labels).toPandas()
    order = ["doc_id", "score"]
    want, got = (d.sort_values(order).reset_index(drop=True) for d in (want, got))
    assert len(got) == len(want) and want["score"].nunique() > 100
    assert np.allclose(got["score"], want["score"], atol=1e-6)
    assert (got["held_out"] == want["held_out"]).all()


def test_arrow_groups_are_the_groups_of_a_list():
    import pyarrow as pa

    from tessella.llm import ragged

    texts = ["", "ab" * 30, "\U0001f30a" * 9, "", "x", "yz" * 4, "w" * 100, ""]
    for limit in (1, 12, 40, 1000):
        assert list(ragged.arrow_groups(pa.array(texts), limit)) == list(ragged.groups(texts, limit))
