"""One object over the stored tables: ingest, search, propose, decide, report.

Every method works on batches of rows and appends its result to the table logs;
nothing is held in the driver.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import DEFAULT, EngineConfig
from tessella.operators import appeals as AP
from tessella.operators import archive as AR
from tessella.operators import conflicts as CF
from tessella.operators import gate as GA
from tessella.operators import genealogy as GE
from tessella.operators import governance as GO
from tessella.operators import hybrid as HY
from tessella.operators import keyword as KW
from tessella.operators import vectors as VE
from tessella.operators.stored_index import KeywordIndex
from tessella.operators.stored_vectors import VectorTable
from tessella.scale import cut, small_side
from tessella.sources.state import TableStore


def _clock(now: Column | None) -> Column:
    """One moment for all jobs of a call: a literal, where none is given."""
    return F.lit(datetime.now(UTC)) if now is None else now


class UnknownSources(ValueError):
    """A proposal cites fragments that are not stored."""


class NotPending(ValueError):
    """An approval names appeals that do not wait for one."""


class Engine:
    def __init__(
        self, spark: SparkSession, root: str, config: EngineConfig = DEFAULT, embed=None
    ) -> None:
        self.spark, self.config = spark, config
        self.store = TableStore(spark, root)
        self.embed = embed or VE.fallback_embedder("index")
        self.conflict_embed = embed or VE.fallback_embedder("conflict")
        self.index = KeywordIndex(spark, f"{root}/keyword_index", config.retrieval)
        self.vectors = VectorTable(spark, f"{root}/vector_table")
        self.last_counts: dict[str, int] = {}

    # -- tables ------------------------------------------------------------------

    def fragments(self) -> DataFrame:
        rows = self.store.read("fragments")
        return rows.where("status <> 'archived'") if self.config.exclude_archived else rows

    def appeals(self) -> DataFrame:
        return self.store.read("appeals")

    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    # -- stored index and vectors -------------------------------------------------------

    def _index(self, rows: DataFrame) -> None:
        """Take new or changed rows into both tables; archived ones leave them."""
        shown = rows.where("status <> 'archived'") if self.config.exclude_archived else rows
        held = cut(shown.select("id", "seq", "content"))
        self.index.add(held)
        self.vectors.add(VE.with_vectors(held, self.embed))

    def _unindex(self, ids: DataFrame) -> None:
        self.index.remove(ids)
        self.vectors.remove(ids)

    def reindex(self) -> None:
        """Write both tables anew from the stored fragments."""
        held = self.fragments().select("id", "seq", "content")
        self.index.rebuild(held)
        self.vectors.rebuild(VE.with_vectors(held, self.embed))

    # -- shelves -----------------------------------------------------------------

    def create_shelf(self, name: str, topic: str = "", threshold: float = 0.80) -> None:
        shelves = self.store.read("shelves")
        if not shelves.where(F.col("name") == name).isEmpty():
            raise ValueError(f"shelf {name!r} exists")
        self.store.append(
            "shelves",
            self.spark.createDataFrame([(name, topic, threshold)], "name string, topic string, threshold double"),
        )

    def shelves(self) -> DataFrame:
        return self.store.read("shelves")

    def drop_shelf(self, name: str) -> bool:
        gone = self.store.read("shelves").where(F.col("name") == name)
        found = not gone.isEmpty()
        if found:
            self.store.append("shelves", cut(gone), removed=True)
        return found

    # -- ingest ------------------------------------------------------------------

    def _next_seq(self) -> Column:
        """Numbers after all stored ones, so parents always come before children."""
        last = [self.store.read(name).agg(F.max("seq")).first()[0] for name in ("fragments", "nodes")]
        return F.lit(max((n for n in last if n is not None), default=-1) + 1) + F.monotonically_increasing_id()

    def prepare(self, rows: DataFrame, now: Column | None = None) -> DataFrame:
        """Fill defaults and checksum of new rows (``id, content`` at least)."""
        texts = F.array().cast("array<string>")
        defaults = {
            "seq": self._next_seq(), "shelf": F.lit("main"), "topic": F.lit(""),
            "source": F.lit(""), "quality": F.lit(0.0), "author": F.lit(""), "tags": texts,
            "parents": texts, "status": F.lit("active"), "created_at": _clock(now),
        }
        out = rows
        for name, value in defaults.items():
            out = out.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
        if "provenance" not in rows.columns:
            from tessella import schemas

            out = out.withColumn("provenance", F.lit(None).cast(schemas.PROVENANCE))
        return out.withColumn("quality", AR.clamp01(F.col("quality"))).withColumn(
            "checksum", AR.checksum(F.col("id"), F.col("content"), F.col("created_at"))
        )

    def ingest(self, rows: DataFrame, now: Column | None = None, model_id: str = "") -> DataFrame:
        """Gate, insert and record nodes; returns ``id, accepted, reject_reason``."""
        now = _clock(now)
        shelf = self.store.read("shelves").select(
            F.col("name").alias("shelf"), F.col("topic").alias("_topic"), F.col("threshold").alias("_shelf_threshold")
        )
        prepared = self.prepare(rows, now).join(small_side(shelf), "shelf", "left").withColumn(
            "topic", F.coalesce(F.nullif("topic", F.lit("")), "_topic", F.lit(""))
        ).drop("_topic")
        guarded = cut(GA.guard(prepared, self.config.gate, floor=F.col("_shelf_threshold")))
        passed = self.prepare(GA.admitted(guarded).drop("checksum", "_shelf_threshold"), now)
        judged = cut(AR.insert(passed, self.store.read("fragments"), self.config))
        stored = judged.where("accepted")
        whole, watch = AR.counted(judged)
        self.store.append("fragments", whole.where("accepted"))
        self.last_counts = watch.get
        self._index(stored)
        self.store.append("rejected", GA.rejections(guarded))
        self.store.append(
            "nodes",
            stored.select(
                F.col("id").alias("fragment_id"), "seq", "parents",
                F.col("created_at").alias("timestamp"), "checksum",
                F.lit(model_id).alias("model_id"),
                F.coalesce(F.col("provenance.final_source"), F.lit("")).alias("quality_source"),
            ),
        )
        refused = GA.rejections(guarded).select("id", F.lit(False).alias("accepted"), F.col("reason").alias("reject_reason"))
        return judged.select("id", "accepted", "reject_reason").unionByName(refused)

    def delete(self, ids: DataFrame) -> None:
        """Soft delete."""
        hit = self.store.read("fragments").join(ids.select("id"), "id", "left_semi")
        hit = cut(hit.withColumn("status", F.lit("archived")))
        self.store.append("fragments", hit)
        if self.config.exclude_archived:
            self._unindex(hit.select("id"))

    # -- search ------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int | None = None, shelves: list[str] | None = None) -> DataFrame:
        """Hybrid hits of ``qid, text`` rows.

        The whole archive is searched in its stored index and vectors. A choice of shelves has
        word statistics of its own, so its rows are scanned; their vectors are the stored ones.
        """
        asked = queries.select("qid", self.embed(F.col("text")).alias("vec"))
        if not self.index.exists():
            self.reindex()
        if not shelves:
            return HY.retrieve_stored(self.index, self.vectors, queries, asked, k)
        rows = self.fragments().where(F.col("shelf").isin(*shelves)).select("id", "seq", "content")
        vectors = self.vectors.living().join(small_side(rows.select("id")), "id", "left_semi")
        return HY.retrieve(rows, vectors, queries, asked, k, self.config.retrieval)

    def search_shelves(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """Hybrid hits per shelf, each with its own statistics."""
        if not self.index.exists():
            self.reindex()
        rows = self.fragments().select("shelf", "id", "seq", "content")
        vectors = self.vectors.living().join(rows.select("id", "shelf"), "id")
        asked = queries.select("qid", self.embed(F.col("text")).alias("vec"))
        return HY.retrieve_per_shelf(rows, vectors, queries, asked, k, self.config.retrieval)

    def compose(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        k = k or self.config.retrieval.top_k
        return HY.compose_answers(self.search(queries, k), self.fragments(), queries, k)

    # -- appeals -----------------------------------------------------------------

    def propose(self, drafts: DataFrame, now: Column | None = None) -> DataFrame:
        """Store drafts (``id, seq, sources, ops, proposed_content, explanation``).

        Unknown sources fail the whole batch; limits are judged row by row. Metrics
        and diff of accepted drafts are stored with them.
        """
        missing = AP.missing_sources(drafts, self.store.read("fragments"))
        lost = missing.select("source_id").distinct().limit(20).collect()
        if lost:
            raise UnknownSources(f"source fragments not found: {[r[0] for r in lost]}")
        judged = cut(AP.insert(drafts, self.appeals(), self.config.appeals))
        accepted = judged.where("accepted").withColumn("status", F.lit("draft")).withColumn(
            "created_at", _clock(now)
        )
        full = AP.with_diff(AP.with_metrics(AP.dossier(accepted, self.store.read("fragments")), self.config.metrics))
        self.store.append(
            "appeals",
            full.withColumn("metrics", F.struct(F.col("delta_token").cast("int"), "coverage", "risk", "aggregate_score"))
            .withColumn("diff", F.struct("added", "removed", "modified", "reordered")),
        )
        return judged.select("id", "accepted", "reject_reason")

    def submit(self, ids: DataFrame) -> DataFrame:
        outcome = AP.submit(self.appeals(), ids)
        found = outcome.where("found").select("id", F.col("status").alias("_s"))
        rows = self.appeals().join(found, "id").withColumn("status", F.col("_s"))
        self.store.append("appeals", cut(rows.drop("_s")))
        return outcome

    def approve(self, ids: DataFrame, now: Column | None = None, approver: str = "user") -> DataFrame:
        """Promote pending appeals to fragments; returns the new rows."""
        now = _clock(now)
        new_rows, new_nodes, refused = GO.approve(self.appeals(), ids, self.store.read("fragments"), now, approver)
        bad = refused.limit(20).collect()
        if bad:
            raise NotPending(f"appeals not pending approval: {[r[0] for r in bad]}")
        new_rows = cut(new_rows)
        stored = cut(self.prepare(new_rows.drop("appeal_id"), now))
        numbers = stored.select(F.col("id").alias("fragment_id"), "seq")
        self.store.append("fragments", stored)
        self._index(stored)
        self.store.append("nodes", cut(new_nodes.withColumn("timestamp", now).join(numbers, "fragment_id")))
        done = self.appeals().join(ids.select("id"), "id", "left_semi")
        self.store.append("appeals", cut(done.withColumn("status", F.lit("approved")).withColumn("resolved_at", now)))
        return new_rows

    def reject(self, requests: DataFrame, now: Column | None = None) -> None:
        hit = self.appeals().join(requests.select("id"), "id", "left_semi")
        self.store.append("appeals", cut(AP.reject(hit, requests, _clock(now))))

    def prune_appeals(self, now: Column, **limits) -> int:
        gone = cut(AP.prune(self.appeals(), now, config=self.config.appeals, **limits).where("pruned"))
        if not gone.isEmpty():
            self.store.append("appeals", gone, removed=True)
        return gone.count()

    def reports(self, ids: DataFrame | None = None) -> DataFrame:
        """Report rows of all or the given appeals, with conflicts against the archive."""
        chosen, stored = self.appeals(), self.store.read("fragments")
        if ids is not None:
            chosen = chosen.join(ids.select("id"), "id", "left_semi")
        conflicts = CF.proposal_conflicts(
            chosen, stored, self.conflict_embed, config=self.config.metrics
        )
        return GO.reports(chosen, stored, self.config, conflicts)

    # -- history -----------------------------------------------------------------

    def history(self, ids: DataFrame) -> DataFrame:
        nodes = self.nodes()
        return GE.version_history(ids.withColumnRenamed("id", "start"), nodes, GE.known_edges(nodes))

    def rollback(self, ids: DataFrame) -> DataFrame:
        archive, answer = GO.rollback(self.store.read("fragments"), self.nodes(), ids)
        hit = archive.join(ids.select("id"), "id", "left_semi")
        answer = cut(answer)
        hit = cut(hit)
        self.store.append("fragments", hit)
        self._unindex(hit.select("id"))
        self._index(hit)
        return answer

    def statistics(self, now: Column | None = None) -> DataFrame:
        now = _clock(now)
        fragments = self.store.read("fragments").count()
        nodes = self.nodes().count()
        rejected = self.store.read("rejected").count()
        return GO.statistics(self.appeals(), self.store.read("quarantine"), now).withColumns(
            {"fragments": F.lit(fragments), "nodes": F.lit(nodes), "rejected_by_gate": F.lit(rejected)}
        )
