"""Schemas of the logical tables, as DDL strings."""

RAW_EVENT = (
    "title STRING, description STRING, url STRING, source STRING, source_event_id STRING, start_time STRING, end_time STRING, "
    "venue_name STRING, address STRING, is_free BOOLEAN, organizer STRING, image_url STRING, raw_date STRING"
)
SCRAPED = f"page_id BIGINT, strategy STRING, candidates INT, position INT, {RAW_EVENT}"
EVENTS = (
    "id STRING, title STRING, description STRING, start_time TIMESTAMP, end_time TIMESTAMP, location STRING, venue_name STRING, "
    "address STRING, url STRING, source STRING, source_event_id STRING, audience_type ARRAY<STRING>, technical_level STRING, "
    "is_free BOOLEAN, price STRING, organizer STRING, image_url STRING, is_verified BOOLEAN, created_at TIMESTAMP, "
    "updated_at TIMESTAMP, deleted_at TIMESTAMP, merged_into_id STRING"
)
SOURCES = (
    "url STRING, name STRING, source_type STRING, trust_tier STRING, is_active BOOLEAN, trust_score DOUBLE, validation_context STRING, "
    "validation_pass_count INT, validation_fail_count INT, consecutive_empty_scrapes INT, consecutive_parse_failures INT, "
    "consecutive_fetch_failures INT, events_found_count INT, last_scraped TIMESTAMP, created_at TIMESTAMP"
)
SEARCH_QUERIES = (
    "id STRING, query_text STRING, query_type STRING, created_by STRING, is_active BOOLEAN, times_run INT, sources_found INT, "
    "priority_score DOUBLE, last_run TIMESTAMP, last_success_at TIMESTAMP, created_at TIMESTAMP"
)
DECISIONS = "event STRING, source STRING, stage STRING, outcome STRING, reason STRING, claude_called BOOLEAN, ts TIMESTAMP"
PAGE_VIEWS = "page STRING, visitor_type STRING, user_agent STRING, created_at TIMESTAMP"
DEDUP_TRACE = "id STRING, match_id STRING, layer INT, candidates ARRAY<STRUCT<layer: INT, match_id: STRING>>"
