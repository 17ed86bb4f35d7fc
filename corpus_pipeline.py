"""A corpus pipeline of five stages: toxicity, language, near-duplicates, mixing, pieces.

Each stage takes (spark, docs, folder) and works on all rows of ``docs``; ``folder`` holds
the labels. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import fresh
from tessella.llm.language_id import UNDETERMINED, CrossParser, learning_sample, predicted
from tessella.llm.mixing import copies, mix_documents
from tessella.llm.near_duplicates import near_duplicates
from tessella.llm.piece_sampling import encode_samples
from tessella.llm.queries import tokenizer_file
from tessella.llm.toxicity import labelled_texts, with_scores
from tessella.scale import cut, small_side

TOXIC_SCORE = 0.7
SHINGLE_WORDS = 5
TARGETS = {"plain": 0.9, "low": 0.1}
SAMPLES = 2


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows scored below TOXIC_SCORE; learned from every labelled row of ``docs``."""
    labelled = labelled_texts(docs, _labels(spark, folder), F.lit(True))
    name = fresh(docs, "score")
    return with_scores(docs, labelled, name).where(F.col(name) < TOXIC_SCORE).drop(name)


def drop_undetermined(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows whose language can be told: a NULL text or one without letters goes."""
    parser = CrossParser.fit(learning_sample(docs, F.lit(True), "doc_id", "text", "lang"))
    name = fresh(docs, "language")
    told = docs.withColumn(name, predicted(docs, parser, F.col("text"))["lang_pred"])
    return told.where(F.col(name) != UNDETERMINED).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row per group of near-duplicates, that of the smallest id, and one row per id.

    Rows without an id belong to no group and stay.
    """
    found = near_duplicates(docs, words=SHINGLE_WORDS)
    gone = cut(found.where(~F.col("kept")).select("doc_id").distinct())
    rest = docs.join(small_side(gone), "doc_id", "left_anti")
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null")
    repeated = small_side(cut(ids.select("doc_id")))
    once = rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rest.join(repeated, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each row as often as its rate says, so that domains meet TARGETS in tokens."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name meets a computed one
    mixed = mix_documents(
        docs.toDF(*names.values()),
        _labels(spark, folder),
        targets=TARGETS,
        id_column=names["doc_id"],
        text_column=names["text"],
        keep=tuple(names.values()),
    )
    times = F.explode(F.sequence(F.lit(0), copies("rate", names["doc_id"]))).alias("times")
    repeated = mixed.select(*names.values(), times).where("times > 0").drop("times")
    return repeated.select(*names.values()).toDF(*names)


def encode_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sampled segmentations: doc_id, lang, source, sample, ids, log_prob, perturbed,
    log_inclusion."""
    return encode_samples(docs, tokenizer_file("piece_bpe_32k.model"), k=SAMPLES, keep=("lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_undetermined),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_to_targets),
    ("pieces", encode_pieces),
]

# Classifiers and sampling are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)


REGISTRY = {"pipeline": run}
ORACLES: dict[str, str] = {}
