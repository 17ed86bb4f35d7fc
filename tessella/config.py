"""Engine parameters.

One frozen object per concern; operators take the values they need as
arguments, so nothing reads a mutable global.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 5
    semantic_threshold: float = 0.72
    bm25_weight: float = 0.4
    vector_weight: float = 0.6
    k1: float = 1.5
    b: float = 0.75
    min_leg_depth: int = 10


@dataclass(frozen=True)
class MetricConfig:
    w_delta: float = 0.3
    w_coverage: float = 0.4
    w_risk: float = 0.3
    contradiction_penalty: float = 0.25
    vagueness_penalty: float = 0.15
    expansion_ratio: float = 2.0
    embedding_blend: float = 0.5
    low_risk: float = 0.1
    conflict_similarity: float = 0.85
    contradiction_check_at: float = 0.85


@dataclass(frozen=True)
class ArchiveConfig:
    max_content_length: int = 10_000


@dataclass(frozen=True)
class AppealConfig:
    max_active: int = 20
    max_ops: int = 10
    max_generations: int = 100
    retention_days: int = 30


@dataclass(frozen=True)
class DispatchConfig:
    compose_at: float = 0.90
    partial_at: float = 0.40
    cost_factor: float = 1.3
    generate_penalty: float = 1.0
    scan_depth: int = 20


@dataclass(frozen=True)
class CompositionConfig:
    block_above: float = 0.5
    warn_above: float = 0.3
    overlap_above: float = 0.75


@dataclass(frozen=True)
class IntakeConfig:
    candidate_threshold: float = 0.35
    min_aspects: int = 2
    proceed_share: float = 0.4
    top_k: int = 10
    count_cap: int | None = None  # no limit


@dataclass(frozen=True)
class PatternConfig:
    base_thresholds: dict = field(
        default_factory=lambda: {"function": 4, "constant": 1, "library": 1, "phrase": 12}
    )
    threshold_min: int = 1
    threshold_max: int = 30
    used_delta: float = -0.5
    ignored_delta: float = 0.3
    confirmed_delta: float = -1.0
    dedup_similarity: float = 0.90
    dedup_depth: int = 3
    min_phrase_words: int = 10


@dataclass(frozen=True)
class GateConfig:
    default_threshold: float = 0.80
    source_thresholds: dict = field(
        default_factory=lambda: {
            "user_claimed": 0.95,
            "llm_self_reported": 0.85,
            "heuristic_boosted": 0.85,
            "independently_verified": 0.70,
            "majority_vote": 0.75,
            "rastrello_discovered": 0.80,
            "evaluator_computed": 0.75,
            "inherited": 0.85,
        }
    )
    boost: float = 0.15
    boost_cap: float = 0.95
    improver_floor: float = 0.80


@dataclass(frozen=True)
class CircuitConfig:
    hard_reject: float = 0.60
    grey_high: float = 0.90
    vote_at: float = 0.80
    min_agents: int = 2
    consensus_method: str = "majority_vote_3"


@dataclass(frozen=True)
class QuarantineConfig:
    notify_after_hours: float = 24.0
    alert_threshold: int = 50
    soft_limit: int = 100


@dataclass(frozen=True)
class EngineConfig:
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    metrics: MetricConfig = field(default_factory=MetricConfig)
    archive: ArchiveConfig = field(default_factory=ArchiveConfig)
    appeals: AppealConfig = field(default_factory=AppealConfig)
    dispatch: DispatchConfig = field(default_factory=DispatchConfig)
    composition: CompositionConfig = field(default_factory=CompositionConfig)
    intake: IntakeConfig = field(default_factory=IntakeConfig)
    patterns: PatternConfig = field(default_factory=PatternConfig)
    gate: GateConfig = field(default_factory=GateConfig)
    circuit: CircuitConfig = field(default_factory=CircuitConfig)
    quarantine: QuarantineConfig = field(default_factory=QuarantineConfig)
    # optional departures from the default behaviour
    index_on_approve: bool = False
    exclude_archived: bool = False


DEFAULT = EngineConfig()
