"""Schemas of the model's tables, as DDL."""

RAW_PAGE = "document_id STRING, url STRING, html STRING, size_bytes BIGINT"
DOCUMENT = "id STRING, sequence INT, type STRING, description STRING, filename STRING, source_url STRING, local_path STRING, size_bytes BIGINT"
BLOCK = "document_id STRING, pos INT, tag STRING, text STRING, anchor STRING"
SECTION = "id STRING, document_id STRING, title STRING, normalized_title STRING, level INT, ord INT, parent_id STRING, text STRING, source_url STRING, source_anchor STRING"
CHUNK = "id STRING, section_id STRING, document_id STRING, chunk_pos INT, chunk_type STRING, title STRING, text STRING, token_estimate INT, source_url STRING, citation_label STRING"
TABLE = "id STRING, document_id STRING, ord INT, text STRING, source_url STRING, section_id STRING"
FACT = "id STRING, document_id STRING, pos INT, category STRING, label STRING, value_text STRING, plain_english STRING, investor_relevance STRING, confidence STRING, source_chunk_ids ARRAY<STRING>, source_quote STRING, needs_review BOOLEAN"
RISK = "id STRING, document_id STRING, pos INT, title STRING, category STRING, original_text STRING, specificity STRING, confidence STRING, source_section_id STRING, source_chunk_ids ARRAY<STRING>, source_quote STRING, character_length INT, extraction_method STRING, risk_extraction_type STRING, needs_review BOOLEAN, extraction_warning STRING"
CARD = "id STRING, card_pos INT, topic STRING, title STRING, source_section_id STRING, source_chunk_ids ARRAY<STRING>, source_quote STRING, extracted_text STRING, plain_english STRING, why_it_matters STRING, confidence STRING, needs_review BOOLEAN, extraction_method STRING, quality_warnings ARRAY<STRING>"
REJECTED = "id STRING, topic STRING, title STRING, source_chunk_ids ARRAY<STRING>, reasons ARRAY<STRING>"
MANIFEST = "document_id STRING, sha256 STRING, size_bytes BIGINT, versions MAP<STRING,STRING>"
