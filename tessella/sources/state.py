"""Readers and writers of engine tables: JSON documents, JSON lines and Parquet logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions import words as W
from tessella.operators.archive import checksum, clamp01, iso_utc, restore
from tessella.scale import small_side

KNOWN_METADATA = ("topic", "source", "date", "quality", "provenance", "author", "tags")
FRAGMENT_JSON = (
    "struct<id:string,content:string,metadata:map<string,string>,"
    f"conditions:{schemas.CONDITIONS},parents:array<string>,status:string,"
    "created_at:string,checksum:string>"
)
APPEAL_JSON = (
    f"struct<id:string,sources:array<string>,ops:{schemas.OPERATIONS},diff:{schemas.DIFF},"
    f"metrics:{schemas.METRICS},status:string,proposed_content:string,explanation:string,"
    "created_at:string,resolved_at:string>"
)
NODE_JSON = (
    "struct<fragment_id:string,parent_ids:array<string>,child_ids:array<string>,appeal_id:string,"
    "approver:string,timestamp:string,checksum:string,promotion_notes:string,depth:int,"
    "model_id:string,model_version:string,evaluator_model_id:string,"
    "evaluator_model_version:string,quality_source:string,provenance_snapshot:string>"
)
STATE_JSON = (
    f"archive struct<fragments:array<{FRAGMENT_JSON}>>, "
    f"appeal_space struct<appeals:array<{APPEAL_JSON}>>, "
    f"genealogy struct<nodes:map<string,{NODE_JSON}>>"
)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly the columns of ``ddl``; missing ones are NULL."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(ddl).fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def _domain(value: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The value itself; an unknown one fails the job."""
    return F.when(value.isin(*allowed), value).otherwise(
        F.raise_error(F.concat(F.lit(f"unknown {what}: "), value))
    )


def parse_fragments(raw: DataFrame) -> DataFrame:
    """Raw JSON fragment rows (``FRAGMENT_JSON`` plus ``pos``) to the working layout."""
    m = F.col("metadata")
    extra = F.map_filter(m, lambda k, v: ~k.isin(*KNOWN_METADATA))
    no_text = F.array().cast("array<string>")
    c = F.col("conditions")
    conditions = F.struct(
        F.coalesce(c["keywords"], no_text).alias("keywords"),
        F.coalesce(c["semantic_threshold"], F.lit(0.72)).alias("semantic_threshold"),
        F.coalesce(c["booleans"], F.expr("cast(map() as map<string,boolean>)")).alias("booleans"),
        F.coalesce(c["regex_patterns"], no_text).alias("regex_patterns"),
        F.coalesce(c["require_all_keywords"], F.lit(False)).alias("require_all_keywords"),
    )
    rows = raw.select(
        "id",
        F.col("pos").cast("long").alias("seq"),
        F.lit(None).cast("string").alias("shelf"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce(m["topic"], F.lit("")).alias("topic"),
        F.coalesce(m["source"], F.lit("")).alias("source"),
        F.try_to_timestamp(m["date"]).alias("date"),
        clamp01(F.coalesce(m["quality"].try_cast("double"), F.lit(0.0))).alias("quality"),
        F.from_json(m["provenance"], schemas.PROVENANCE).alias("provenance"),
        F.coalesce(m["author"], F.lit("")).alias("author"),
        F.coalesce(F.from_json(m["tags"], "array<string>"), no_text).alias("tags"),
        F.coalesce(extra, F.expr("cast(map() as map<string,string>)")).alias("extra"),
        conditions.alias("conditions"),
        F.coalesce("parents", no_text).alias("parents"),
        _domain(F.coalesce("status", F.lit("active")), schemas.FRAGMENT_STATUSES, "status").alias("status"),
        F.try_to_timestamp("created_at").alias("created_at"),
        F.col("checksum").alias("_sum"),
    )
    return rows.withColumn(
        "checksum",
        F.when(F.coalesce("_sum", F.lit("")) != "", F.col("_sum")).otherwise(
            checksum(F.col("id"), F.col("content"), F.col("created_at"))
        ),
    ).drop("_sum")


def parse_appeals(raw: DataFrame) -> DataFrame:
    ops = F.transform(
        F.coalesce("ops", F.array().cast(schemas.OPERATIONS)),
        lambda o: o.withField("op_type", _domain(o["op_type"], schemas.OPERATION_TYPES, "operation")),
    )
    return conform(
        raw.withColumn("seq", F.col("pos").cast("long"))
        .withColumn("status", _domain(F.coalesce("status", F.lit("draft")), schemas.APPEAL_STATUSES, "status"))
        .withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
        .withColumn("proposed_content", F.coalesce("proposed_content", F.lit("")))
        .withColumn("explanation", F.coalesce("explanation", F.lit("")))
        .withColumn("ops", ops)
        .withColumn("created_at", F.try_to_timestamp("created_at"))
        .withColumn("resolved_at", F.try_to_timestamp("resolved_at")),
        schemas.APPEALS,
    )


def read_state_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a state written as one JSON document.

    Such a document is a single record, so it suits states that one task can
    hold; use the JSON-lines or Parquet forms beyond that. Repeated ids: the last
    wins, nothing is validated.
    """
    doc = spark.read.schema(STATE_JSON).json(path, multiLine=True)
    fragments = doc.select(F.posexplode("archive.fragments").alias("pos", "r")).select("pos", "r.*")
    appeals = doc.select(F.posexplode("appeal_space.appeals").alias("pos", "r")).select("pos", "r.*")
    nodes = doc.select(F.posexplode(F.map_entries("genealogy.nodes")).alias("seq", "e")).select(
        "seq", "e.value.*"
    )
    return {
        "fragments": restore(parse_fragments(fragments), order="seq"),
        "appeals": restore(parse_appeals(appeals), order="seq"),
        "nodes": conform(
            nodes.withColumn("parents", F.col("parent_ids")).withColumn(
                "timestamp", F.try_to_timestamp("timestamp")
            ),
            schemas.NODES,
        ),
    }


def read_fragment_lines(spark: SparkSession, path: str) -> DataFrame:
    """Fragments from JSON lines, one object per line; later lines win."""
    raw = spark.read.text(path).select(F.from_json("value", FRAGMENT_JSON).alias("r")).select("r.*")
    numbered = raw.withColumn("pos", F.monotonically_increasing_id())
    return restore(parse_fragments(numbered), order="seq")


def fragment_json(fragments: DataFrame) -> DataFrame:
    """``id, json``: extra metadata keys come last and replace known ones."""

    fragments = fragments.withColumn(
        "extra", F.coalesce("extra", F.expr("cast(map() as map<string,string>)"))
    )

    def field(name: str, value: Column) -> Column:
        return F.when(~F.map_contains_key("extra", F.lit(name)), value).alias(name)

    provenance = F.col("provenance").withField(
        "evaluations",
        F.transform("provenance.evaluations", lambda e: e.withField("score", F.round(e["score"], 4))),
    )
    known = F.to_json(
        F.struct(
            field("topic", F.col("topic")),
            field("source", F.col("source")),
            field("date", iso_utc(F.col("date"))),
            field("quality", F.col("quality")),
            field("provenance", F.when(F.col("provenance").isNotNull(), provenance)),
            field("author", F.col("author")),
            field("tags", F.col("tags")),
        )
    )
    extra = F.to_json("extra")
    metadata = (
        F.when(F.size("extra") == 0, known)
        .when(known == "{}", extra)
        .otherwise(
            F.concat(F.substring(known, F.lit(1), F.length(known) - 1), F.lit(","), F.substring(extra, F.lit(2), F.length(extra)))
        )
    )
    outer = F.to_json(
        F.struct(
            "id", "content", "conditions", "parents", "status",
            iso_utc(F.col("created_at")).alias("created_at"), "checksum",
        )
    )
    return fragments.select(
        "id",
        F.concat(F.substring(outer, F.lit(1), F.length(outer) - 1), F.lit(',"metadata":'), metadata, F.lit("}")).alias("json"),
    )


def appeal_json(appeals: DataFrame) -> DataFrame:
    """``id, json``; metric values are rounded here and nowhere else."""
    metrics = F.col("metrics")
    for name in ("coverage", "risk", "aggregate_score"):
        metrics = metrics.withField(name, W.rounded(F.col(f"metrics.{name}"), 4))
    return appeals.select(
        "id",
        F.to_json(
            F.struct(
                "id", "sources", "ops", "diff",
                F.when(F.col("metrics").isNotNull(), metrics).alias("metrics"),
                "status", "proposed_content", "explanation",
                iso_utc(F.col("created_at")).alias("created_at"),
                iso_utc(F.col("resolved_at")).alias("resolved_at"),
            )
        ).alias("json"),
    )


def write_json_lines(tables: dict[str, DataFrame], path: str) -> None:
    """Distributed export: one folder of JSON lines per table."""
    fragment_json(tables["fragments"]).select("json").write.mode("overwrite").text(f"{path}/fragments")
    appeal_json(tables["appeals"]).select("json").write.mode("overwrite").text(f"{path}/appeals")
    tables["nodes"].write.mode("overwrite").json(f"{path}/nodes")


class TableStore:
    """Append-only Parquet logs with merge on read.

    A table is a base plus later commits. Reading overlays the commits: rows of
    the base whose key changed later are left out by an anti join, which is a
    broadcast while the changes are few, so the base is never shuffled for it.
    ``compact`` folds everything into a new base. Every change is one append
    under its own number, so a lost executor or driver leaves either the old or
    the new state. One writer at a time, as many readers as wanted.
    """

    LAYOUT = {
        "fragments": ("id", schemas.FRAGMENTS),
        "appeals": ("id", schemas.APPEALS),
        "nodes": ("fragment_id", schemas.NODES),
        "quarantine": ("fragment_id", schemas.QUARANTINE),
        "shelves": ("name", "name string, topic string, threshold double"),
        "rejected": (None, "id string, shelf string, quality double, topic string, reason string"),
    }

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, name: str) -> tuple[DataFrame, int, int] | None:
        """Rows of the newest base and its commits, with both numbers."""
        try:
            log = self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise  # unreadable is not the same as absent
            return None
        newest = log.agg(F.max(F.struct("base", "commit")).alias("m")).first()["m"]
        if newest is None:
            return None
        return log.where(F.col("base") == newest["base"]), newest["base"], newest["commit"]

    def read(self, name: str) -> DataFrame:
        key, ddl = self.LAYOUT[name]
        found = self._log(name)
        if found is None:
            return self.spark.createDataFrame([], ddl)
        log, _, last = found
        if key is None or last == 0:
            return conform(log.where(~F.col("removed")), ddl)
        later = restore(log.where("commit > 0"), key, "commit")
        untouched = log.where("commit = 0").join(small_side(later.select(key)), key, "left_anti")
        return conform(untouched, ddl).unionByName(conform(later.where(~F.col("removed")), ddl))

    def append(self, name: str, rows: DataFrame, removed: bool = False) -> None:
        """Add or replace rows, or remove keys when ``removed`` is set."""
        found = self._log(name)
        base, commit = (0, 0) if found is None else (found[1], found[2] + 1)
        self._write(name, rows, base, commit, removed)

    def compact(self, name: str) -> None:
        """Fold base and commits into a new base; the old files stay for open readers."""
        found = self._log(name)
        if found is not None and found[2] > 0:
            self._write(name, self.read(name), found[1] + 1, 0, False)

    def _write(self, name: str, rows: DataFrame, base: int, commit: int, removed: bool) -> None:
        _, ddl = self.LAYOUT[name]
        target = f"{self.root}/{name}/base={base}/commit={commit}"
        marked = conform(rows, ddl).withColumn("removed", F.lit(removed))
        marked.write.mode("overwrite").parquet(target)

    def load(self, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            self.append(name, rows)
