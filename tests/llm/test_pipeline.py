from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F
from tables import ODD_TEXTS, odd_documents
from test_near_duplicates import brute

from tessella.llm.queries import REGISTRY

FOLDER = "/root/testdata/sf0.01"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "language", "near_duplicates", "mixing", "pieces"]
    calm = P.cut(stages["toxicity"](spark, docs, FOLDER))
    assert calm.columns == docs.columns and 0 < docs.count() - calm.count() < 150
    marked = labels.join(calm, "doc_id", "left_anti").join(docs, "doc_id")
    assert marked.where("toxic = 1").count() > 0.8 * labels.where("toxic = 1").count()
    told = P.cut(stages["language"](spark, calm, FOLDER))
    assert told.columns == docs.columns
    assert told.count() == calm.where(F.col("text").rlike(r"\p{L}")).count()
    single = P.cut(stages["near_duplicates"](spark, told, FOLDER))
    rows = [(r["doc_id"], r["text"]) for r in told.collect()]
    assert {r["doc_id"] for r in single.collect()} == {c for *_, c in brute(rows, 5)}
    mixed = P.cut(stages["mixing"](spark, single, FOLDER))
    assert mixed.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in single.collect()}
    assert all(kept[r["doc_id"]] == r["text"] for r in mixed.collect())
    assert abs(mixed.count() / single.count() - 1) < 0.3
    pieces = stages["pieces"](spark, mixed, FOLDER)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert Counter(r["doc_id"] for r in pieces.select("doc_id").collect()) == {i: P.SAMPLES * n for i, n in times.items()}


def test_stages_keep_extra_columns_and_odd_rows(spark):
    docs = odd_documents(spark)
    left = docs
    for name, stage in P.STAGES[:-1]:
        left = P.cut(stage(spark, left, FOLDER))
        assert left.columns == docs.columns, name
    ids = {r["doc_id"] for r in left.collect()}
    assert not ids & {2, 3, 4, 5, 9} and len(ids) <= len(ODD_TEXTS)
    empty = docs.where("false")
    for _, stage in P.STAGES:
        out = stage(spark, empty, FOLDER)
        assert out.count() == 0


def test_one_row_per_id(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (None, "x y"), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = P.drop_near_duplicates(spark, docs, FOLDER)
    assert sorted(map(repr, (r["doc_id"] for r in left.collect()))) == ["1", "None", "None"]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 11))
    assert set(P.REGISTRY) == {"pipeline"}
