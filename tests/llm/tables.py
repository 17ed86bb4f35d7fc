"""Small tables with every awkward kind of row."""

from pyspark.sql import functions as F

LONG = "the quick brown fox jumps over it again. " * 6000
ODD_TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n ", "de", None),
    (5, "123 456 !!", None, "b"),
    (None, "No id but words enough to be a text of its own kind here.", "en", "b"),
    (6, LONG, "en", "b"),
    (7, "Der schnelle braune Fuchs springt heute über den faulen Hund am Fluss.", "de", "b"),
    (7, "Der schnelle braune Fuchs springt heute über den faulen Hund am Fluss.", "de", "b"),
    (8, "日本語 😀 é́ ▁ ß\x00x", None, "a"),
    (9, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
    (10, "word", "en", "a"),
    (100, "a<|endoftext|>b 'tis ''s don't", "en", "c"),
]
CLASHES = (
    "_id _text row score component component_id _bucket _pos _group _d _edge key k0 k1 lang_pred held_out "
    "predicted rate n_tokens n_words kept _words class bucket part place draw calibrates h toxic_"
).split()


def odd_documents(spark, rows=ODD_TEXTS):
    df = spark.createDataFrame(
        [(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    return df.withColumns({name: F.lit(-1) for name in CLASHES})


def odd_labels(spark):
    df = spark.createDataFrame(
        [(1, 1, 0), (6, 0, 0), (7, 1, 1), (7, 1, 1), (None, 1, 1), (9, None, None), (10, 1, 0), (100, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    return df.withColumns({name: F.lit(-1) for name in CLASHES if name not in ("toxic_",)})


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
