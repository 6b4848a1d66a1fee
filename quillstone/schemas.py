"""The tables of a document corpus: schemas and the constraints each one has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import constraints as C

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PLACE = f"page_start int, page_end int, bbox_start {BOX}, bbox_end {BOX}"

TABLES: dict[str, str] = {
    "documents": "id string, url string, filename string, title string, doc_type string, status string, content_hash string, source_published_at timestamp, ingested_at timestamp, last_checked_at timestamp, fiscal_year int, budget_stage string, raw_api_response variant",
    "provisions": "id string, document_id string, node_id string, parent_node_id string, depth int, effective_date date, superseded_date date, is_current boolean, section_title string, content string, content_hash string, source_type string, embedding array<float>, attempts int, next_attempt_at timestamp, last_error string",
    "vote_tallies": f"id string, document_id string, meeting_date date, motion_text string, motion_type string, outcome string, vote_yes int, vote_no int, vote_abstain int, vote_absent int, individual_votes array<struct<supervisor_name:string,district:string,vote:string>>, reconsidered_by string, chunk_sequence int, {PLACE}, embedding array<float>",
    "policy_decisions": f"id string, document_id string, meeting_date date, decision_type string, subject string, fiscal_year int, amount_dollars decimal(15,2), rate_value decimal(10,4), rate_unit string, effective_date date, is_amendment boolean, amends_decision_id string, vote_tally_id string, {PLACE}, embedding array<float>",
    "indicators": "id string, document_id string, fiscal_year int, department string, program string, indicator_name string, value_actual decimal(15,4), value_target decimal(15,4), value_prior_year decimal(15,4), unit string, effective_date date, effective_date_source string, raw_extracted_text string, embedding array<float>",
    "narratives": f"id string, document_id string, chunk_sequence int, content string, token_count int, overlap_prev boolean, overlap_next boolean, {PLACE}, embedding array<float>",
    "document_chunks": "id string, document_id string, chunk_index int, content string, embedding array<float>",
    "amendment_events": "id string, node_id string, adopted_date date, effective_date date, vote_tally_id string, source string",
    "pending_changes": "id string, node_id string, proposed_text string, codification_status string, effective_date date, document_id string",
    "reconciliation_logs": "id string, pending_change_id string, provision_id string, result string, reconciled_at timestamp",
    "resolution_logs": "id string, decision_id string, status string, reason string, resolved_at timestamp",
    "crosswalk": "id string, topic string, provision_id string, citation string, effective_date date, superseded_date date",
    "ingestions": "id string, url string, doc_type string, status string, attempts int, detected_at timestamp, next_attempt_at timestamp, started_at timestamp, last_error string",
    "rate_buckets": "ip string, window_start timestamp, request_count long",
    "request_logs": "id string, query_text string, response_ms long, chunk_count int, llm_calls int, at timestamp, temporal boolean, unverified boolean, incomplete boolean, refused boolean",
    "alerts": "id string, alert_type string, reason string, alert_key string, dedupe_key string, details string, triggered_at timestamp, last_seen_at timestamp, occurrence_count long, acknowledged boolean",
    "crawl_state": "source_id string, resume_state string, updated_at timestamp, pages long, candidates long, created long",
    "reprint_state": "document_id string, next_page int, page_count int, updated_at timestamp",
    "reprint_pages": "document_id string, page_no int, text string",
    "app_config": "key string, value string",
}

# What status columns may hold.
STATUS = {
    ("documents", "status"): ("current", "superseded", "unknown"),
    ("documents", "budget_stage"): ("adopted", "advertised", "markup"),
    ("ingestions", "status"): ("pending", "processing", "done", "failed", "skipped"),
    ("pending_changes", "codification_status"): ("pending", "codified", "superseded"),
    ("reconciliation_logs", "result"): ("matched", "partial_match", "mismatch", "not_found"),
    ("resolution_logs", "status"): ("resolved", "unresolved"),
}
UNIQUE = {
    "documents": (("url",),), "provisions": (("node_id", "effective_date"),), "narratives": (("document_id", "chunk_sequence"),), "document_chunks": (("document_id", "chunk_index"),), "reconciliation_logs": (("pending_change_id", "provision_id"),),
    "resolution_logs": (("decision_id",),), "crosswalk": (("provision_id",),), "rate_buckets": (("ip", "window_start"),), "alerts": (("dedupe_key",),), "crawl_state": (("source_id",),), "reprint_pages": (("document_id", "page_no"),), "app_config": (("key",),),
}
REFERENCES = {
    "provisions": (("document_id", "documents", "id"),), "vote_tallies": (("document_id", "documents", "id"), ("reconsidered_by", "vote_tallies", "id")), "policy_decisions": (("document_id", "documents", "id"), ("vote_tally_id", "vote_tallies", "id"), ("amends_decision_id", "policy_decisions", "id")),
    "indicators": (("document_id", "documents", "id"),), "narratives": (("document_id", "documents", "id"),), "crosswalk": (("provision_id", "provisions", "id"),), "reconciliation_logs": (("pending_change_id", "pending_changes", "id"), ("provision_id", "provisions", "id")),
}


def violations(name: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rule -> rows of tables[name] that break it. References are checked where the other table is given."""
    df, out = tables[name], {}
    for (table, column), values in STATUS.items():
        if table == name and column in df.columns:
            out[f"{name}.{column} is a known value"] = C.not_in(df, column, values)
    for keys in UNIQUE.get(name, ()):
        if set(keys) <= set(df.columns):
            out[f"{name}.({', '.join(keys)}) is unique"] = C.repeated(df, *keys)
    for column, other, key in REFERENCES.get(name, ()):
        if other in tables and column in df.columns:
            out[f"{name}.{column} refers to {other}"] = C.dangling(df, column, tables[other], key)
    if name == "provisions":
        out["provisions: one current version a node"] = C.repeated(df, "node_id", where=F.col("is_current"))
    if name == "crosswalk":
        out["crosswalk: one open version a topic"] = C.open_versions(df, "topic")
        out["crosswalk: an interval ends after it starts"] = C.bad_intervals(df)
    if name == "ingestions":
        out["ingestions: one active row for a URL and type"] = C.repeated(df, "url", "doc_type", where=F.col("status").isin("pending", "processing"))
    return out
