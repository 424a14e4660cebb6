"""Declared schemas of the stores; nothing is inferred."""

from __future__ import annotations

LEDGER_EVENT = (
    "schema string, event_id string, kind string, ts string, evidence_class string, run_id string, model_id string, condition string, specimen_id string, specimen_sha string, question_id string, "
    "candidate_id string, stage string, failure_code string, layer string, pass boolean, overall_score double, score_before double, score_after double, delta double, mutation string, "
    "parent_event_ids array<string>, tags array<string>"
)
CAMPAIGN = "schema string, benchmark_id string, trials array<struct<id: string, model_id: string, condition: string, diagnostic_mode: boolean, specimen: struct<id: string, sha256: string>, responses: array<struct<question_id: string, text: string, latency_ms: bigint>>>>"
GROUNDING_CASE = "id string, question string, answer string, evidence string, expected string, family string"
WORKER = "worker_id string, capability string, scope string, domain string, engine string, params bigint, requires array<string>, produces array<string>"
