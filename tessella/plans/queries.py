"""Registered queries: every operator over the whole test tables.

Each entry takes (spark, folder) and returns flat rows, so the same result can be
stated in SQL (see :mod:`tessella.plans.checks`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import PatternConfig, EngineConfig
from tessella.functions import words as W
from tessella.operators import (
    appeals as AP,
    archive as AR,
    composition as CO,
    conflicts as CF,
    dispatch as DI,
    gate as GA,
    genealogy as GE,
    governance as GO,
    hybrid as HY,
    intake as IN,
    keyword as KW,
    lookup as LK,
    patterns as PA,
    quarantine as QU,
    records as RE,
    vectors as VE,
    voting as VO,
)
from tessella.operators.stored_index import KeywordIndex
from tessella.operators.stored_vectors import VectorTable
from tessella.scale import cut, shared_folder, small_side
from tessella.sources import state as ST
from tessella.sources import testbed as TB

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def now() -> Column:
    """Fixed clock of the test tables."""
    return F.to_timestamp(F.lit(TB.NOW))


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def bar(column: Column | str) -> Column:
    """Array as one string."""
    return F.array_join(column, "|")


def stamp(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# -- archive ---------------------------------------------------------------------


@query
def tokenize_stats(spark, d):
    f = TB.fragments(spark, d)
    toks = W.tokens(F.col("content"))
    return f.select(
        "id",
        F.size(toks).alias("n_tokens"),
        F.size(F.array_distinct(toks)).alias("n_terms"),
        W.word_count(F.col("content")).alias("n_words"),
        F.size(W.word_set(F.col("content"))).alias("n_word_set"),
    )


@query
def fragment_checksum(spark, d):
    return TB.fragments(spark, d).select("id", "checksum", r("quality", 4).alias("quality"))


@query
def archive_insert(spark, d):
    f = TB.fragments(spark, d)
    again = f.withColumn("seq", F.col("seq") + 10_000_000_000)
    incoming = f.unionByName(again).select("id", "seq", "content", "checksum")
    stored = f.where(F.col("status") == "archived")
    return AR.insert(incoming, stored).groupBy(
        F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@query
def ingest_counts(spark, d):
    """What an insert accepted and refused, counted by the write itself."""
    f = TB.fragments(spark, d)
    again = f.withColumn("seq", F.col("seq") + 10_000_000_000)
    judged, watch = AR.counted(AR.insert(f.unionByName(again), f.where(F.col("status") == "archived")))
    judged.where("accepted").write.parquet(shared_folder(spark, "accepted"))
    found = watch.get
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{name} long" for name in found))


@query
def point_lookup(spark, d):
    """Every twentieth fragment and as many unknown ids, from files that tell their ids."""
    f = TB.fragments(spark, d)
    path = shared_folder(spark, "lookup")
    LK.write_lookup(f.select("id", "checksum", "shelf"), path)
    some = f.where("seq % 20 = 0")
    ids = some.select("id").unionByName(some.select(F.concat(F.lit("X-"), "seq").alias("id")))
    return LK.lookup(spark, path, ids).select("id", "found", "checksum", "shelf")


@query
def soft_delete(spark, d):
    f = TB.fragments(spark, d)
    gone = f.where(F.col("quality") < 0.2).select("id")
    return AR.soft_delete(f, gone).groupBy("shelf", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def list_filter(spark, d):
    f = TB.fragments(spark, d)
    return AR.list_fragments(f, topic="en", status="active", tags=["EVEN", "src3"]).select(
        "id", "topic", "status"
    )


@query
def keyword_search(spark, d):
    f = TB.fragments(spark, d)
    return AR.search_by_keywords(f, ["Inthe", "thisand", "que la"]).select("id", "shelf")


@query
def quality_filter(spark, d):
    return AR.search_by_quality(TB.fragments(spark, d), 0.8).select(
        "id", r("quality", 4).alias("quality")
    )


@query
def next_fragment_id(spark, d):
    return AR.next_fragment_number(TB.fragments(spark, d))


@query
def restore_last_wins(spark, d):
    f = TB.fragments(spark, d).select("id", "seq", "shelf", "quality")
    rows = f.withColumn("pos", F.col("seq")).unionByName(
        f.where("quality >= 0.5").withColumn("pos", F.col("seq") + 10_000_000_000).withColumn(
            "shelf", F.lit("restored")
        )
    )
    return AR.restore(rows).groupBy("shelf").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("quality"), 4).alias("quality_sum")
    )


@query
def fragment_json(spark, d):
    out = ST.fragment_json(TB.fragments(spark, d))
    field = lambda path: F.get_json_object("json", path)
    return out.select(
        "id", F.md5(field("$.content")).alias("digest"), field("$.metadata.topic").alias("topic"),
        r(field("$.metadata.quality").cast("double"), 4).alias("quality"),
        field("$.created_at").alias("created_at"), field("$.checksum").alias("checksum"),
        field("$.metadata.provenance.final_source").alias("final_source"),
    )


@query
def open_records(spark, d):
    e = TB.table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("data"))
    out = RE.mark_processed(e)
    return out.select(
        "event_id", RE.get_metadata(F.col("data"), "k").alias("k"),
        RE.get_metadata(F.col("data"), "processed").alias("processed"), F.size("data").alias("n"),
    )


@query
def embedding_seeds(spark, d):
    f = TB.fragments(spark, d)
    return f.select(
        "id", VE.seed_column("index")("content").alias("index_seed"),
        VE.seed_column("conflict")("content").alias("conflict_seed"),
    )


@query
def provenance_update(spark, d):
    f = TB.fragments(spark, d).where(F.col("provenance").isNotNull())
    extra = F.struct(
        now().alias("timestamp"), F.lit("m").alias("model_id"), F.lit("1").alias("model_version"),
        (F.col("quality") / 2).alias("score"), F.lit("inherited").alias("source"),
        F.expr("cast(map() as map<string,string>)").alias("metadata"),
    )
    once = AR.add_evaluation(F.col("provenance"), extra)
    out = f.withColumn("p", once).withColumn(
        "p2", AR.set_consensus(F.col("p"), F.col("quality"), F.lit("mean"))
    )
    return out.select(
        "id",
        F.col("p.final_source").alias("source_1"),
        r("p.final_quality", 4).alias("quality_1"),
        F.col("p2.final_source").alias("source_2"),
        r("p2.final_quality", 4).alias("quality_2"),
        r(AR.latest_evaluation(F.col("p"))["score"], 4).alias("latest"),
        F.size(AR.evaluations_from(F.col("p"), "inherited")).alias("n_inherited"),
    )


@query
def shelf_statistics(spark, d):
    f = TB.fragments(spark, d)
    rejected = GA.rejections(GA.guard(f))
    kept = f.join(rejected.select("id"), "id", "left_anti")
    return AR.shelf_statistics(kept, rejected).select(
        F.coalesce("shelf", F.lit("total")).alias("shelf"), "fragments", "rejected"
    )


# -- retrieval -------------------------------------------------------------------


def flagship(spark, d):
    hits = KW.bm25(TB.fragments(spark, d), TB.queries(spark, d), 5)
    return hits.select("qid", "id", "rank", r("score").alias("score"))


@query
def bm25_topk(spark, d):
    return flagship(spark, d)


@query
def stored_index_topk(spark, d):
    """Search of an index that grew by batches, had texts replaced and rows removed."""
    f = TB.fragments(spark, d)
    stale = f.withColumn("content", F.concat_ws(" ", F.lit("stale words"), "topic", "content", "shelf"))
    index = KeywordIndex(spark, shared_folder(spark, "keyword-index"))
    index.rebuild(f.where("seq % 3 = 0").unionByName(stale.where("seq % 3 = 1")))
    index.add(f.where("seq % 3 = 2"))
    index.add(f.where("seq % 3 = 1"))
    index.remove(f.where("quality < 0.2"))
    return index.search(TB.queries(spark, d), 5).select("qid", "id", "rank", r("score").alias("score"))


@query
def shelf_bm25_topk(spark, d):
    hits = KW.bm25(TB.fragments(spark, d), TB.queries(spark, d), 3, by_shelf=True)
    return hits.select("qid", "shelf", "id", "rank", r("score").alias("score"))


@query
def vector_topk(spark, d):
    hits = VE.nearest(TB.fragment_vectors(spark, d), TB.query_vectors(spark, d), 5)
    return hits.select("qid", "id", "rank", r("score").alias("score"))


@query
def stored_vector_topk(spark, d):
    """Search of a vector table that grew by batches, had vectors replaced and rows removed."""
    f, v = TB.fragments(spark, d), TB.fragment_vectors(spark, d)
    stale = v.withColumn("vec", F.reverse("vec"))
    table = VectorTable(spark, shared_folder(spark, "vector-table"))
    table.rebuild(v.where("seq % 3 = 0").unionByName(stale.where("seq % 3 = 1")))
    table.add(v.where("seq % 3 = 2"))
    table.add(v.where("seq % 3 = 1"))
    table.remove(f.where("quality < 0.2").select("id"))
    hits = table.search(TB.query_vectors(spark, d), 5)
    return hits.select("qid", "id", "rank", r("score").alias("score"))


@query
def minmax_norm(spark, d):
    hits = KW.bm25(TB.fragments(spark, d), TB.queries(spark, d), 10)
    return HY.min_max(hits, ["qid"]).select("qid", "id", r("norm").alias("norm"))


def _hybrid(spark, d, k=5):
    return HY.retrieve(
        TB.fragments(spark, d), TB.fragment_vectors(spark, d), TB.queries(spark, d),
        TB.query_vectors(spark, d), k,
    )


@query
def hybrid_topk(spark, d):
    return _hybrid(spark, d).select("qid", "id", "rank", r("score").alias("score"))


@query
def compose_text(spark, d):
    answers = HY.compose_answers(_hybrid(spark, d), TB.fragments(spark, d), TB.queries(spark, d))
    return answers.select("qid", "n", F.length("answer").alias("n_chars"), F.md5("answer").alias("digest"))


@query
def retrieve_with_conflicts(spark, d):
    f, v = TB.fragments(spark, d), TB.fragment_vectors(spark, d)

    def narrowed(ids):
        some = small_side(ids)
        return CF.conflict_features(f.join(some, "id", "left_semi"), v.join(some, "id", "left_semi"))

    return CF.hit_conflicts(_hybrid(spark, d), v, narrowed=narrowed).select(
        "qid", "id", "rank", "n_conflicts", r("max_similarity").alias("max_similarity"),
        r("max_contradiction").alias("max_contradiction"),
    )


def _vector_table(spark, d):
    table = VectorTable(spark, shared_folder(spark, "vector-table"))
    table.rebuild(TB.fragment_vectors(spark, d))
    return table


def _hit_entries(spark, d, hits):
    """Listed conflicts of the fragments among the hits."""
    f, v = TB.fragments(spark, d), TB.fragment_vectors(spark, d)
    features = CF.conflict_features(f, v)
    probes = features.join(hits.select("id").distinct(), "id", "left_semi").join(f.select("id", "content"), "id")
    return CF.listed_conflicts(probes, _vector_table(spark, d), features.select("id", "left", "right"), f, excerpt_chars=None)


ENTRY = ("id", "other_id", "method", "excerpt")


def _entry_columns():
    return [*ENTRY, r("similarity", 4).alias("similarity"), r("contradiction", 4).alias("contradiction")]


@query
def hit_conflict_entries(spark, d):
    """Every conflict of every retrieved fragment with the archive."""
    return _hit_entries(spark, d, cut(_hybrid(spark, d))).select(*_entry_columns())


@query
def proposal_conflict_entries(spark, d):
    """Every conflict of every proposal with the archive, its own sources apart."""
    a, f = TB.appeals(spark, d), TB.fragments(spark, d)
    texts = a.select("id", F.col("proposed_content").alias("content"))
    probes = CF.conflict_features(texts, TB.appeal_vectors(spark, d)).join(texts, "id").join(
        a.select("id", F.col("sources").alias("exclude")), "id"
    )
    stored = CF.conflict_features(f, TB.fragment_vectors(spark, d)).select("id", "left", "right")
    return CF.listed_conflicts(probes, _vector_table(spark, d), stored, f, excerpt_chars=None).select(*_entry_columns())


@query
def answers_with_warnings(spark, d):
    """Composed answers with a line for each conflict of their fragments."""
    hits = cut(_hybrid(spark, d))
    answers = HY.compose_answers(hits, TB.fragments(spark, d), TB.queries(spark, d))
    lines = CF.warning_lines(hits, _hit_entries(spark, d, hits))
    full = answers.join(lines, "qid", "left").withColumn("full", HY.with_warnings(F.col("answer"), F.col("warnings")))
    return full.select(
        "qid", F.coalesce(F.size("warnings"), F.lit(0)).alias("n_warnings"),
        F.md5(F.array_join(F.coalesce("warnings", F.array().cast("array<string>")), "\n")).alias("warnings_digest"),
        (F.length("full") - F.length("answer")).alias("added"),
    )


@query
def shelf_hybrid_topk(spark, d):
    """Both legs per shelf, with the shelf's own statistics and scales."""
    f = TB.fragments(spark, d)
    vectors = TB.fragment_vectors(spark, d).join(f.select("id", "shelf"), "id")
    hits = HY.retrieve_per_shelf(f, vectors, TB.queries(spark, d), TB.query_vectors(spark, d), 3)
    return hits.select("qid", "shelf", "id", "rank", r("score").alias("score"))


# -- intake, dispatch, composition -----------------------------------------------


@query
def aspects(spark, d):
    q = TB.queries(spark, d)
    return q.select(
        "qid",
        bar(W.aspects(F.col("text"))).alias("aspects"),
        bar(W.composition_aspects(F.col("text"))).alias("composition_aspects"),
    )


@query
def intake_candidates(spark, d):
    hits = IN.candidates(TB.fragments(spark, d), TB.queries(spark, d), 10)
    return hits.select("qid", "id", "rank", r("sim").alias("sim"))


@query
def intake_scan(spark, d):
    out = IN.scan(TB.fragments(spark, d), TB.queries(spark, d), 10)
    return out.select(
        "qid",
        bar(F.transform("certified", lambda c: c["id"])).alias("certified"),
        bar("matched").alias("matched"),
        bar("missing").alias("missing"),
        r("max_similarity").alias("max_similarity"),
        "should_proceed",
    )


@query
def certified_exists(spark, d):
    return IN.has_certified_for(TB.fragments(spark, d), TB.queries(spark, d))


@query
def certified_count(spark, d):
    return IN.certified_count(TB.fragments(spark, d), TB.queries(spark, d))


@query
def dispatch_route(spark, d):
    out = DI.dispatch(TB.fragments(spark, d), TB.queries(spark, d))
    return out.select(
        "qid", "path", r("coverage").alias("coverage"), r("compose_cost", 4).alias("compose_cost"),
        r("generate_cost", 4).alias("generate_cost"), "gap_description",
        bar("covered").alias("covered"),
    )


@query
def dispatch_reason(spark, d):
    return DI.dispatch(TB.fragments(spark, d), TB.queries(spark, d)).select("qid", "reason")


@query
def tabs_slots(spark, d):
    return CO.connectors(TB.fragments(spark, d)).select(
        "id", bar("tabs").alias("tabs"), bar("slots").alias("slots")
    )


@query
def text_connectors(spark, d):
    return CO.text_connectors(TB.appeals(spark, d), "id", "proposed_content").select(
        "id", bar("tabs").alias("tabs"), bar("slots").alias("slots")
    )


def _scanned(spark, d):
    return IN.scan(TB.fragments(spark, d), TB.queries(spark, d), 20)


@query
def composition_gaps(spark, d):
    return CO.find_gaps(cut(_scanned(spark, d)), TB.fragments(spark, d)).select(
        "qid", bar("gaps").alias("gaps")
    )


def _exploded_pairs(spark, d, find):
    checked = CO.with_word_sets(_scanned(spark, d))
    return checked.select("qid", F.explode(find(F.col("members"))).alias("p")).select(
        "qid", F.col("p.a").alias("a"), F.col("p.b").alias("b"), r("p.score").alias("score")
    )


@query
def jaccard_overlaps(spark, d):
    return _exploded_pairs(spark, d, CO.find_overlaps)


@query
def contradiction_pairs(spark, d):
    return _exploded_pairs(spark, d, CO.find_contradictions)


@query
def composition(spark, d):
    out = CO.compose(_scanned(spark, d), TB.fragments(spark, d))
    return out.select(
        "qid", "success", "partial", "blocked", F.size("gaps").alias("n_gaps"),
        F.size("overlaps").alias("n_overlaps"), F.size("contradictions").alias("n_contradictions"),
        F.md5("output").alias("digest"),
    )


# -- appeals and governance --------------------------------------------------------


def _measured(spark, d):
    return AP.with_metrics(AP.dossier(TB.appeals(spark, d), TB.fragments(spark, d)))


@query
def appeal_insert(spark, d):
    a = TB.appeals(spark, d)
    incoming = a.unionByName(a.withColumn("seq", F.col("seq") + 1))
    return AP.insert(incoming, a.limit(0)).groupBy(
        F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@query
def active_appeals(spark, d):
    return AP.running_active(TB.appeals(spark, d))


@query
def retention_prune(spark, d):
    out = AP.prune(TB.appeals(spark, d), now(), retention_days=10)
    return out.select("id", "status", "pruned")


@query
def count_prune(spark, d):
    out = AP.prune(TB.appeals(spark, d), now(), max_generations=40, retention_days=100_000)
    return out.where("pruned").select("id", "status")


@query
def source_resolution(spark, d):
    return AP.resolve_sources(TB.appeals(spark, d), TB.fragments(spark, d).select("id", "seq", "shelf")).select(
        "id", "pos", "source_id", "shelf"
    )


@query
def missing_sources(spark, d):
    return AP.missing_sources(TB.appeals(spark, d), TB.fragments(spark, d)).select("id", "pos", "source_id")


@query
def appeals_citing(spark, d):
    return AP.appeals_citing(TB.appeals(spark, d), "D-000007").select("id", "status")


@query
def appeal_metrics(spark, d):
    return _measured(spark, d).select(
        "id", "delta_token", r("coverage").alias("coverage"), r("risk").alias("risk"),
        r("aggregate_score").alias("aggregate_score"),
    )


@query
def blended_metrics(spark, d):
    """Metrics with the best cosine to a source in their coverage, and negations as risk."""
    a, f = TB.appeals(spark, d), TB.fragments(spark, d)
    best = AP.best_cosine(a, TB.appeal_vectors(spark, d), TB.fragment_vectors(spark, d))
    full = AP.with_metrics(AP.dossier(a, f).join(best, "id"), vector_coverage="best_cosine")
    return full.select(
        "id", r("best_cosine").alias("best_cosine"), r("coverage").alias("coverage"), r("risk").alias("risk"),
        r("aggregate_score").alias("aggregate_score"),
    )


@query
def appeal_diff(spark, d):
    return AP.with_diff(_measured(spark, d)).select(
        "id",
        F.size("added").alias("n_added"),
        F.size("removed").alias("n_removed"),
        F.md5(bar("added")).alias("added"),
        F.size("modified").alias("n_modified"),
        F.md5(F.array_join(F.transform("modified", lambda m: F.concat_ws(":", m["line_num"], m["old"], m["new"])), "|")).alias("modified"),
        bar(F.transform("reordered", lambda i: i.cast("string"))).alias("reordered"),
    )


@query
def governance_pros_cons(spark, d):
    full = AP.with_diff(_measured(spark, d))
    pros, cons = AP.governance_pros_cons()
    return full.select("id", F.size(pros).alias("n_pros"), F.size(cons).alias("n_cons"),
                       F.get(pros, F.lit(0)).alias("first_pro"), bar(cons).alias("cons"))


@query
def review_pros_cons(spark, d):
    pros, cons = AP.review_pros_cons(F.col("ops"))
    return _measured(spark, d).select("id", bar(pros).alias("pros"), bar(cons).alias("cons"))


@query
def appeal_explanation(spark, d):
    return _measured(spark, d).select(
        "id", AP.explanation_text(F.col("ops"), F.size("cited")).alias("explanation")
    )


@query
def vagueness_negation(spark, d):
    return TB.appeals(spark, d).select(
        "id", r(W.vagueness(F.col("proposed_content"))).alias("vagueness"),
        r(W.negation_share(F.col("proposed_content"))).alias("negation"),
    )


@query
def antonym_score(spark, d):
    a, f = TB.appeals(spark, d), TB.fragments(spark, d)
    pairs = AP.resolve_sources(a, f.select("id", "seq", "content")).join(
        a.select("id", "proposed_content"), "id"
    )
    score = W.text_antonym_score(F.col("proposed_content"), F.col("content"))
    return pairs.select("id", "pos", r(score).alias("score"))


@query
def overlap_excerpt(spark, d):
    a, f = TB.appeals(spark, d), TB.fragments(spark, d)
    pairs = AP.resolve_sources(a, f.select("id", "seq", "content")).join(
        a.select("id", "proposed_content"), "id"
    )
    return pairs.select(
        "id", "pos", W.overlap_excerpt(F.col("proposed_content"), F.col("content")).alias("excerpt")
    )


@query
def merge_metadata(spark, d):
    out = GO.merged_metadata(AP.dossier(TB.appeals(spark, d), TB.fragments(spark, d)))
    return out.select("id", "m_topic", bar("m_tags").alias("m_tags"), "m_quality", "m_author")


@query
def provenance_summary(spark, d):
    out = GO.provenance_summary(AP.dossier(TB.appeals(spark, d), TB.fragments(spark, d)))
    return out.select("id", "n_sources", "min_quality", "max_quality", "mean_quality",
                      bar("quality_sources").alias("quality_sources"))


@query
def quality_distribution(spark, d):
    out = AP.dossier(TB.appeals(spark, d), TB.fragments(spark, d))
    return out.select("id", GO.quality_text(out).alias("summary"))


@query
def model_provenance(spark, d):
    out = AP.dossier(TB.appeals(spark, d), TB.fragments(spark, d))
    return GO.model_provenance(out, TB.nodes(spark, d)).select(
        "id", "source_id", "model_id", "model_version", "evaluator_model_id", "quality_source"
    )


@query
def approve_pending(spark, d):
    a = TB.appeals(spark, d)
    rows, nodes, _ = GO.approve(a, a.select("id"), TB.fragments(spark, d), now())
    return rows.join(nodes.select(F.col("fragment_id").alias("id"), "model_id", "quality_source"), "id").select(
        "id", "appeal_id", "topic", r("quality", 4).alias("quality"), "author", "checksum",
        "model_id", "quality_source",
    )


@query
def reject_appeals(spark, d):
    a = TB.appeals(spark, d)
    requests = a.where("status = 'pending_user_approval'").select(
        "id", F.when(F.col("seq") % 2 == 0, F.lit("too long")).otherwise(F.lit("")).alias("reason")
    )
    return AP.reject(a, requests, now()).groupBy("status", "explanation").agg(F.count(F.lit(1)).alias("n"))


@query
def submit_appeals(spark, d):
    a = TB.appeals(spark, d)
    ids = a.where("status <> 'draft'").select("id").unionByName(
        a.select(F.concat("id", F.lit("-unknown")).alias("id"))
    )
    return AP.submit(a, ids)


@query
def update_proposals(spark, d):
    a = TB.appeals(spark, d)
    changes = a.where("status = 'draft'").select(
        "id", F.lit("first").alias("explanation"), F.lit(1).alias("change_seq")
    ).unionByName(
        a.where("status = 'draft' AND seq % 3 = 0").select(
            "id", F.lit("second").alias("explanation"), F.lit(2).alias("change_seq")
        )
    )
    return AP.overlay(a, changes, ["explanation"]).select("id", "explanation")


@query
def change_status(spark, d):
    a = TB.appeals(spark, d)
    steps = a.where("status = 'draft'").select(
        "id", F.lit("pending_user_approval").alias("status"), F.lit(1).alias("change_seq")
    ).unionByName(
        a.where("status = 'draft' AND seq % 2 = 0").select(
            "id", F.lit("approved").alias("status"), F.lit(2).alias("change_seq")
        )
    )
    return AP.set_status(a, steps, now()).select(
        "id", "status", stamp("resolved_at").alias("resolved_at")
    )


@query
def appeals_by_status(spark, d):
    return AP.by_status(TB.appeals(spark, d), "approved").select(
        "id", stamp("created_at").alias("created_at"), stamp("resolved_at").alias("resolved_at")
    )


@query
def appeal_json(spark, d):
    a = _measured(spark, d).withColumn(
        "metrics", F.struct(F.col("delta_token").cast("int").alias("delta_token"), "coverage", "risk", "aggregate_score")
    )
    out = ST.appeal_json(ST.conform(a, ST.schemas.APPEALS))
    field = lambda path: F.get_json_object("json", path)
    return out.select(
        "id", field("$.status").alias("status"), field("$.created_at").alias("created_at"),
        field("$.metrics.coverage").cast("double").alias("coverage"),
        field("$.metrics.risk").cast("double").alias("risk"),
    )


@query
def governance_stats(spark, d):
    return GO.statistics(TB.appeals(spark, d), TB.quarantine(spark, d), now())


@query
def governance_report(spark, d):
    out = GO.reports(TB.appeals(spark, d), TB.fragments(spark, d))
    return out.select("id", "delta_token", r("risk").alias("risk"), F.size("cited").alias("n_cited"),
                      F.md5("report_explanation").alias("explanation"), bar("pros").alias("pros"),
                      "mean_quality", F.md5("quality_distribution").alias("distribution"))


@query
def report_conflicts(spark, d):
    """Proposals against the archive with the built-in fallback embedding."""
    return CF.proposal_conflicts(
        TB.appeals(spark, d), TB.fragments(spark, d), VE.fallback_embedder("conflict"), 0.15
    )


@query
def appeal_answers(spark, d):
    a = TB.appeals(spark, d)
    answer = HY.appeal_answer(
        F.lit("composed"), F.col("id"), F.col("status"), F.col("proposed_content"), F.col("explanation")
    )
    return a.select("id", F.md5(answer).alias("digest"))


@query
def side_by_side(spark, d):
    out = GO.with_side_by_side(AP.dossier(TB.appeals(spark, d), TB.fragments(spark, d)))
    return out.select("id", F.md5("side_by_side").alias("digest"), F.length("side_by_side").alias("n"))


# -- quality -----------------------------------------------------------------------


@query
def guardian_gate(spark, d):
    out = GA.guard(TB.fragments(spark, d))
    return out.select("id", "threshold", "decision")


@query
def heuristic_improve(spark, d):
    out = GA.admitted(GA.guard(TB.fragments(spark, d)))
    return out.select("id", r("quality", 4).alias("quality"), bar("tags").alias("tags"),
                      F.length("content").alias("n_chars"), "author",
                      F.col("provenance").isNotNull().alias("has_provenance"))


def _voted(spark, d):
    return VO.evaluate(TB.fragments(spark, d), VO.mock_scorers(noisy=False))


@query
def circuit_route(spark, d):
    f = TB.fragments(spark, d)
    return f.select("id", VO.route(F.col("quality"), F.col("provenance.final_source")).alias("route"))


@query
def circuit_vote(spark, d):
    return _voted(spark, d).select(
        "id", "route", "votes_for", "votes_against", "accepted", "consensus",
        r("mean_score", 4).alias("mean_score"), r("min_score", 4).alias("min_score"),
        r("max_score", 4).alias("max_score"),
    )


@query
def vetted_fragments(spark, d):
    out = VO.accepted_fragments(_voted(spark, d), now())
    return out.select(
        "id", r("quality", 4).alias("quality"), F.col("provenance.final_source").alias("final_source"),
        F.size("provenance.evaluations").alias("n_evaluations"),
        F.col("provenance.consensus_method").alias("method"),
    )


@query
def mock_agent_base(spark, d):
    f = TB.fragments(spark, d)
    return f.select("id", r(VO.base_score(F.col("content"), F.col("quality")), 4).alias("score"))


@query
def mock_agent_noise(spark, d):
    scored = VO.with_scores(TB.fragments(spark, d), VO.mock_scorers())
    return scored.select("id", F.explode("scores").alias("agent", "score"))


def _judged(spark, d):
    return VO.judge_examples(TB.calibration(spark, d), VO.mock_scorers(noisy=False))


@query
def calibration_summary(spark, d):
    out = VO.calibration_summary(_judged(spark, d))
    return out.select("total", "correct", "false_positives", "false_negatives",
                      r("mean_agreement").alias("mean_agreement"),
                      r("mean_score_error").alias("mean_score_error"), r("accuracy").alias("accuracy"))


@query
def scorer_summary(spark, d):
    out = VO.scorer_summary(_judged(spark, d))
    return out.select("agent", r("accuracy", 4).alias("accuracy"), r("own_accuracy", 4).alias("own_accuracy"),
                      r("generosity", 4).alias("generosity"))


@query
def agreement_rate(spark, d):
    return _judged(spark, d).select("id", "majority", r("agreement").alias("agreement"))


@query
def calibration_labels(spark, d):
    return VO.counts_by_label(TB.calibration(spark, d))


@query
def calibration_filters(spark, d):
    c = TB.calibration(spark, d)
    return c.where(F.col("claimed_quality").between(0.6, 0.9) & (F.col("category") == "en")).select(
        "id", "ground_truth", r("claimed_quality", 4).alias("claimed_quality")
    )


@query
def stratified_sample(spark, d):
    return VO.stratified_sample(TB.calibration(spark, d)).select("ground_truth", "rank", "id")


# -- genealogy ---------------------------------------------------------------------


def _newest(spark, d):
    """The newest fragment of every shelf."""
    return TB.fragments(spark, d).groupBy("shelf").agg(F.max_by("id", "seq").alias("start")).select("start")


def _oldest(spark, d):
    return TB.fragments(spark, d).groupBy("shelf").agg(F.min_by("id", "seq").alias("start")).select("start")


@query
def dag_roots_leaves(spark, d):
    n = TB.nodes(spark, d)
    e = GE.known_edges(n)
    return GE.roots(n).withColumn("kind", F.lit("root")).unionByName(
        GE.leaves(n, e).withColumn("kind", F.lit("leaf"))
    )


@query
def dag_depth(spark, d):
    n = TB.nodes(spark, d)
    return GE.depths(n, GE.known_edges(n))


@query
def ancestors(spark, d):
    n = TB.nodes(spark, d)
    return GE.ancestors(_newest(spark, d), n, GE.known_edges(n))


@query
def descendants(spark, d):
    n = TB.nodes(spark, d)
    return GE.descendants(_oldest(spark, d), n, GE.known_edges(n))


@query
def ancestors_capped(spark, d):
    n = TB.nodes(spark, d)
    return GE.ancestors(_newest(spark, d), n, GE.known_edges(n), max_depth=2)


@query
def cycle_check(spark, d):
    n = TB.nodes(spark, d)
    e = GE.known_edges(n).select("parent", "child")
    back = e.where(F.col("child").startswith("F-")).select(
        F.col("child").alias("parent"), F.col("parent").alias("child")
    )
    clean, looped = GE.has_cycle(n, e), GE.cycle_members(n, e.unionByName(back))
    return looped.select(F.lit(clean).alias("clean_has_cycle"), "fragment_id")


@query
def best_parent(spark, d):
    return GO.best_parent(TB.nodes(spark, d), TB.fragments(spark, d))


@query
def lineage(spark, d):
    """Ordered ancestry of every fragment that closes a shelf, and of the F- fragments."""
    n = TB.nodes(spark, d)
    starts = _newest(spark, d).unionByName(n.where("fragment_id like 'F-%'").select(F.col("fragment_id").alias("start"))).distinct()
    return GE.lineage(starts, n, GE.known_edges(n)).select("start", "number", "fragment_id", "distance")


@query
def version_records(spark, d):
    """Whole histories with their nodes, of every fragment that closes a shelf."""
    n = TB.nodes(spark, d)
    full = GE.version_records(_newest(spark, d), n, GE.known_edges(n))
    return full.select("start", "depth", *[bar(c).alias(c) for c in ("ancestors", "descendants", "parents", "children")])


@query
def version_history(spark, d):
    n = TB.nodes(spark, d)
    return GE.version_history(_newest(spark, d), n, GE.known_edges(n))


@query
def rollback(spark, d):
    f, n = TB.fragments(spark, d), TB.nodes(spark, d)
    ids = _newest(spark, d).withColumnRenamed("start", "id")
    archive, answer = GO.rollback(f, n, ids)
    return answer.join(archive.select("id", "status"), "id").select("id", "previous", "status")


@query
def node_model_stats(spark, d):
    return GE.model_statistics(TB.nodes(spark, d))


@query
def remove_node(spark, d):
    n = TB.nodes(spark, d)
    gone = TB.fragments(spark, d).where("status = 'archived'").select(F.col("id").alias("fragment_id"))
    left = GE.remove_node(n, gone)
    return left.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("parents")).alias("links")
    )


@query
def nodes_by_model(spark, d):
    return TB.nodes(spark, d).where("model_id = 'm1' AND evaluator_model_id = 'e2'").select(
        "fragment_id", "model_version"
    )


# -- conflicts ---------------------------------------------------------------------


def _features(spark, d):
    return CF.conflict_features(TB.fragments(spark, d), TB.fragment_vectors(spark, d))


def _conflict_columns(out):
    return out.select(
        "id", "n_conflicts", r("max_similarity").alias("max_similarity"),
        r("max_contradiction").alias("max_contradiction"), "n_opposed",
    )


@query
def archive_conflicts(spark, d):
    return _conflict_columns(CF.scan_archive(_features(spark, d)))


@query
def archive_conflicts_wide(spark, d):
    return _conflict_columns(CF.scan_archive(_features(spark, d), threshold=0.3))


# -- patterns ----------------------------------------------------------------------


def _occurrences(spark, d):
    texts = TB.fragments(spark, d).select("seq", F.col("shelf").alias("context"), "content")
    return PA.scan_documents(texts)


@query
def phrase_patterns(spark, d):
    return _occurrences(spark, d).select("seq", "pos", "name", F.substring("hash", 1, 12).alias("hash"))


@query
def pattern_trackers(spark, d):
    return PA.trackers(_occurrences(spark, d)).select(
        "key", "cnt", "name", "context", "first_seq", "last_seq", "ready"
    )


@query
def pattern_dump(spark, d):
    return _occurrences(spark, d).select(
        "seq", "pos", "type", F.substring("content", 1, 100).alias("preview"), "context",
        F.substring("hash", 1, 12).alias("hash"),
    )


@query
def pattern_statistics(spark, d):
    return PA.tracker_statistics(PA.trackers(_occurrences(spark, d)))


LOW = EngineConfig(patterns=PatternConfig(base_thresholds={"phrase": 3}))


@query
def pattern_candidates(spark, d):
    out = PA.candidates(_occurrences(spark, d), TB.fragments(spark, d), LOW)
    return out.select("key", "seq", "pos", "occurrence")


@query
def pattern_certify(spark, d):
    f = TB.fragments(spark, d)
    out = PA.certify(PA.candidates(_occurrences(spark, d), f, LOW), f)
    return out.select("id", "topic", "seq", bar("tags").alias("tags"), "source", bar("keywords").alias("keywords"))


@query
def code_detection(spark, d):
    return TB.fragments(spark, d).select("id", W.looks_like_code(F.col("content")).alias("is_code"))


@query
def feedback_thresholds(spark, d):
    return PA.adapt_thresholds(TB.feedback(spark, d), TB.feedback_trackers(spark, d))


# -- quarantine --------------------------------------------------------------------


@query
def quarantine_pending(spark, d):
    out = QU.pending_notifications(TB.quarantine(spark, d), now())
    return out.select("fragment_id", r(QU.age_hours(F.col("quarantined_at"), now()), 4).alias("age_hours"))


@query
def quarantine_alerts(spark, d):
    return QU.alerts(TB.quarantine(spark, d), now())


@query
def quarantine_notices(spark, d):
    out = QU.mark_notified(TB.quarantine(spark, d), now())
    return out.groupBy(
        "resolved", (F.col("notified_at") == now()).alias("stamped_now"), F.col("notified_at").isNull().alias("never")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def quarantine_dump(spark, d):
    f = TB.fragments(spark, d).select("id", "topic", "quality")
    q = TB.quarantine(spark, d).withColumn("fragment_id", F.regexp_replace("fragment_id", "^E-([0-9]+)$", "$1"))
    q = q.withColumn("fragment_id", TB.fragment_id(F.col("fragment_id").cast("long")))
    return QU.dump(q, f).select("fragment_id", "reason", "resolved", "topic", r("quality", 4).alias("quality"))


@query
def quarantine_fold(spark, d):
    e = TB.table(spark, d, "events")
    action = (
        F.when(F.col("event_type") == "error", F.lit("quarantine"))
        .when(F.col("event_type") == "view", F.lit("notify"))
        .when(F.col("event_type") == "click", F.lit("resolve"))
        .when((F.col("event_type") == "purchase") & (F.col("value") > 60), F.lit("release"))
    )
    log = e.select(
        F.concat(F.lit("U-"), "user_id").alias("fragment_id"), action.alias("action"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("reason"),
    ).where(F.col("action").isNotNull())
    return QU.fold(log).select(
        "fragment_id", stamp("quarantined_at").alias("quarantined_at"),
        stamp("notified_at").alias("notified_at"), "resolved", "resolution",
    )
