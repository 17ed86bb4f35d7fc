"""Table schemas (Spark DDL) and value domains."""

from __future__ import annotations

EVALUATION = (
    "struct<timestamp:timestamp,model_id:string,model_version:string,score:double,"
    "source:string,metadata:map<string,string>>"
)
PROVENANCE = (
    f"struct<evaluations:array<{EVALUATION}>,final_quality:double,final_source:string,"
    "consensus_score:double,consensus_method:string>"
)
CONDITIONS = (
    "struct<keywords:array<string>,semantic_threshold:double,booleans:map<string,boolean>,"
    "regex_patterns:array<string>,require_all_keywords:boolean>"
)
OPERATIONS = "array<struct<op_type:string,params:map<string,string>,description:string>>"
DIFF = (
    "struct<added:array<string>,removed:array<string>,"
    "modified:array<struct<line_num:int,old:string,new:string>>,reordered:array<int>>"
)
METRICS = "struct<delta_token:int,coverage:double,risk:double,aggregate_score:double>"

# Flat working layout of one fragment per row.
FRAGMENTS = (
    "id string, seq bigint, shelf string, content string, topic string, source string, "
    f"date timestamp, quality double, provenance {PROVENANCE}, author string, "
    f"tags array<string>, extra map<string,string>, conditions {CONDITIONS}, "
    "parents array<string>, status string, created_at timestamp, checksum string"
)
APPEALS = (
    f"id string, seq bigint, sources array<string>, ops {OPERATIONS}, diff {DIFF}, "
    f"metrics {METRICS}, status string, proposed_content string, explanation string, "
    "created_at timestamp, resolved_at timestamp"
)
NODES = (
    "fragment_id string, seq bigint, parents array<string>, appeal_id string, approver string, "
    "timestamp timestamp, checksum string, promotion_notes string, depth int, model_id string, "
    "model_version string, evaluator_model_id string, evaluator_model_version string, "
    "quality_source string, provenance_snapshot string"
)
QUARANTINE = (
    "fragment_id string, reason string, quarantined_at timestamp, notified_at timestamp, "
    "resolved boolean, resolution string"
)

# Names that appear in stored data.
FRAGMENT_STATUSES = ("active", "archived", "deprecated", "pending_review")
OPERATION_TYPES = ("merge", "reorder", "prune", "annotate", "split", "rewrite", "condense")
# Must match (statuses, sources, paths, types).
APPEAL_STATUSES = ("draft", "pending_user_approval", "approved", "rejected", "expired")
CLOSED_APPEAL_STATUSES = ("approved", "rejected", "expired")
DECIDED_APPEAL_STATUSES = ("approved", "rejected")
QUALITY_SOURCES = (
    "user_claimed",
    "llm_self_reported",
    "heuristic_boosted",
    "independently_verified",
    "majority_vote",
    "rastrello_discovered",
    "evaluator_computed",
    "inherited",
)
DISPATCH_PATHS = ("compose", "partial", "generate")
PATTERN_TYPES = ("function", "constant", "library", "phrase")
# Must match.
CALIBRATION_LABELS = ("good", "borderline", "bad", "junk")
