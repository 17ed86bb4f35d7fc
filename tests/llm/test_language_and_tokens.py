import pandas as pd
import pytest
from pyspark.sql import functions as F
from tables import ODD_TEXTS, odd_documents
from tokenizers import Tokenizer

from tessella.llm import language_id, ragged
from tessella.llm.language_id import BLOCK, CrossParser, identify_languages, normalised, suffix_automaton
from tessella.llm.queries import tokenizer_file
from tessella.llm.token_count import RankMerger, count_tokens

FOLDER = "/root/testdata/sf0.01"


def test_automaton_reads_exactly_the_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    steps = suffix_automaton(text)
    inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}

    def reads(word):
        state = 0
        for s in word:
            if s not in steps[state]:
                return False
            state = steps[state][s]
        return True

    import itertools

    for n in range(5):
        for word in itertools.product((1, 2, 3), repeat=n):
            assert reads(word) == (word in inside)


def brute_phrases(sample, symbols, known):
    """Greedy longest matches by searching the sample, block by block."""
    count = 0
    for at in range(0, len(symbols), BLOCK):
        block = symbols[at : at + BLOCK]
        i = 0
        while i < len(block):
            j = i + 1
            if block[i] in known:
                while j < len(block) and block[i : j + 1] in sample:
                    j += 1
            if j < len(block) and block[j] not in known and block[i] in known:
                j += 1  # a symbol never shown ends the phrase and belongs to it
            count += 1
            i = j
    return count


def test_phrases_equal_those_found_by_search():
    samples = {"a": ["the cat sat on the mat", "that hat"], "b": ["der hund und der mann", "und"]}
    parser = CrossParser.fit(samples)
    texts = ["the dog sat and that", "und der hut", "qqq the", "zz", "", "x" * 700 + " the cat " * 100]
    codes, offsets = normalised(texts)
    symbols = parser.symbols(codes)
    found = parser.phrases(symbols, offsets)
    for i, name in enumerate(parser.languages):
        own, own_offsets = normalised(samples[name])
        parts = [own[a:b] for a, b in zip(own_offsets[:-1], own_offsets[1:])]
        flat = "".join("".join(map(chr, parser.symbols(p) + 1)) + chr(1) for p in parts)
        for t in range(len(texts)):
            text = "".join(map(chr, symbols[offsets[t] : offsets[t + 1]] + 1))
            assert found[t, i] == brute_phrases(flat, text, set(flat)), (name, texts[t][:20])


def test_normalised_letters():
    codes, offsets = normalised(["Ab, c!", "", "12", " É\n", "x1y"])
    texts = ["".join(chr(c) if c else " " for c in codes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    assert texts == ["ab c", "", "", "é", "x y"]


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) == 1000 and found["score"].between(0, 1).all()
    held = found[found["held_out"] & found["lang"].notna()]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_language_edges(spark):
    docs = odd_documents(spark)
    got = {r["doc_id"]: r for r in identify_languages(docs).collect()}
    assert identify_languages(docs).count() == len(ODD_TEXTS)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4, 5))
    assert got[1]["lang_pred"] == got[9]["lang_pred"] and got[None]["held_out"] is False
    assert identify_languages(docs.where("false")).count() == 0
    nothing = identify_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in nothing.collect()} == {("und", 0.0)}


def test_sample_is_bounded(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sample = language_id.learning_sample(docs, F.lit(True), "doc_id", "text", "lang", rows=20, chars=2000)
    assert set(sample) == {"de", "en", "es", "fr"} and all(sum(map(len, v)) <= 2000 for v in sample.values())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


def test_counts_equal_the_library(library):
    import random

    random.seed(3)
    odd = [t[1] or "" for t in ODD_TEXTS] + [
        "", "ΑΣ ΟΔΟΣ", "İstanbul ǅ", "<|endoftext", "aaaa aaaaa", "½ ² 123", "​ \x1c x\x85y", "'re're'S'LL", "'",
        "<|startoftext|><|endoftext|>", "👨‍👩‍👧",
    ]
    letters = "abs'tdlmre <|>́é1 \n.😀ΣA"
    odd += ["".join(random.choice(letters) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    merger = RankMerger(tokenizer_file("word_bpe_49k.json"))
    want = [len(e.ids) for e in library.encode_batch(odd, add_special_tokens=False)]
    assert merger.counts(odd).tolist() == want
    assert merger.counts(odd[::-1]).tolist() == want[::-1]  # with a warm cache
    merger.cache = ragged.SpanCache(limit=10)  # that is emptied again and again
    assert merger.counts(odd).tolist() == want


def test_token_query(spark, library):
    path = tokenizer_file("word_bpe_49k.json")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = count_tokens(docs, path).toPandas().set_index("doc_id").sort_index()
    texts = docs.toPandas().set_index("doc_id").sort_index()["text"]
    want = [len(e.ids) for e in library.encode_batch(texts.tolist(), add_special_tokens=False)]
    assert got["n_tokens"].tolist() == want
    assert got["n_bytes"].tolist() == [len(t.encode()) for t in texts]
    assert got["over_limit"].tolist() == [n > 2048 for n in want]


def test_token_edges(spark, library):
    path = tokenizer_file("word_bpe_49k.json")
    docs = odd_documents(spark)
    got = count_tokens(docs, path).toPandas()
    want = pd.DataFrame(
        [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD_TEXTS]
    )
    key = lambda f: sorted(map(repr, f.astype(float).fillna(-1).itertuples(index=False, name=None)))
    assert key(got[["doc_id", "n_bytes", "n_tokens"]]) == key(want)
    assert count_tokens(docs.where("false"), path).count() == 0
