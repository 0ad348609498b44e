"""Record types of the stored tables, as explicit schemas, with their validity rules."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = {
    "sources": "id string, source_type string, canonical_locator string, title string, trust string, provenance string, retrieved_at timestamp, metadata map<string,string>, identity_key string",
    "documents": "id string, source_id string, content_sha256 string, raw_text string, captured_at timestamp, provenance string",
    "chunks": "id string, document_id string, ordinal int, text string, char_start int, char_end int, provenance string",
    "evidence": "id string, source_id string, document_id string, chunk_id string, quote string, support string, provenance string",
    "atoms": "id string, statement string, claim_status string, evidence_ids array<string>, provenance string, created_at timestamp",
    "cards": "id string, card_type string, prompt string, atom_ids array<string>, evidence_ids array<string>, provenance string, created_at timestamp",
    "pulses": "id string, card_id string, atom_id string, display_fact string, topics array<string>, source_id string, document_id string, evidence_ids array<string>, verified_at timestamp, verification struct<status:string,reason_codes:array<string>,risk_flags:array<string>,provider_used:boolean>, stage_key string, fact_fingerprint string",
    "fact_index": "pulse_id string, card_id string, source_id string, fingerprint string, fact_text string, created_at timestamp",
    "profiles": "id string, display_name string, topic_weights map<string,double>, excluded_topics array<string>, unexpected_discovery_weight double, max_consecutive_topic int",
    "exposures": "id string, profile_id string, card_id string, exposed_at timestamp, outcome string",
    "sessions": "id string, profile_id string, status string, started_at timestamp, ended_at timestamp, position int, generation int",
    "session_cards": "session_id string, card_id string, ordinal int, reason string, fingerprint string",
    "stage_keys": "source_id string, doc_id string, document_id string, parser_version string, document_key string, stage_key string, built_at timestamp",
    "caches": "cache_key string, content_sha256 string, etag string, last_modified string, fetched_at timestamp, parser_version string, document_id string, raw_bytes binary",
    "jobs": "id string, idempotency_key string, stage string, status string, attempts int, next_attempt_at timestamp, lease_owner string, lease_expires_at timestamp, error_class string, error_detail string, created_at timestamp",
    "model_usage": "id string, run_id string, task_type string, model_id string, tier string, input_tokens long, output_tokens long, cached_tokens long, latency_ms double, cache_hit boolean, failed boolean",
    "model_cache": "cache_key string, result string",
    "harness_events": "id string, adapter string, event_type string, occurred_at timestamp, job_status string",
    "discovery_candidates": "id string, provider string, canonical_locator string, identity_key string, title string, discovered_at timestamp, metadata map<string,string>",
    "adapter_state": "adapter string, retry_after timestamp, detail string, updated_at timestamp",
    "runs": "run_id string, status string, started_at timestamp, finished_at timestamp, counters map<string,long>, detail string",
}

#: table -> {violation: predicate that must hold}
RULES: dict[str, dict[str, str]] = {
    "chunks": {"end_after_start": "char_end > char_start", "ordinal": "ordinal >= 0"},
    "sessions": {"end_after_start": "ended_at IS NULL OR ended_at >= started_at"},
    "profiles": {"streak": "max_consecutive_topic BETWEEN 1 AND 20"},
    "documents": {"sha256": "content_sha256 RLIKE '^[a-f0-9]{64}$'"},
    "exposures": {"outcome": "outcome IN ('shown', 'dismissed', 'saved', 'completed')"},
    "pulses": {"fact_length": "length(display_fact) BETWEEN 1 AND 500"},
    "atoms": {"statement_length": "length(statement) BETWEEN 1 AND 4000"},
}


@cache
def fields(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def validate(df: DataFrame, table: str) -> DataFrame:
    """Adds ``violations``: the names of the rules that a row breaks."""
    checks: list[Column] = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in RULES.get(table, {}).items()]
    return df.withColumn("violations", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))


def payload(df: DataFrame) -> DataFrame:
    """Adds the whole record as JSON text."""
    return df.withColumn("payload_json", F.to_json(F.struct(*df.columns)))


def migrate(df: DataFrame, table: str, backfill: dict[str, Column] | None = None) -> DataFrame:
    """``df`` in the current schema: missing columns are added from ``backfill`` or as NULL, others cast."""
    backfill, known = backfill or {}, set(df.columns)
    return df.select(*((F.col(f.name) if f.name in known else backfill.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in fields(table).fields))
