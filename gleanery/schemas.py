"""Schemas and fixed vocabularies of the core relations."""

from __future__ import annotations

RECORDS = "source_url string, task_slug string, scraped_at timestamp, data string, _seq bigint"
LINKS = "url string, filter_label string, status string, discovered_at timestamp, _seq bigint"
LINK_EVENTS = "url string, op string, filter_label string, _seq bigint"
FILES = "basename string, length bigint, content binary"
PAGES = "page_id bigint, url string, html string"
MAPPING_PROPS = "ord int, name string, label string, source array<string>, default_value string, template_name array<string>, type string, required boolean, notes string"
TEMPLATE_PROPS = "template string, ord int, name string, label string, type string, required boolean, thesaurus_id string, generated_id boolean"
THESAURUS_NODES = "thesaurus_id string, node_id string, parent_id string, label string, ord int"
VOCAB_MAP = "property_name string, crawl_value string, canonical_value string, needs_review boolean, occurrences bigint, note string"
SUGGESTIONS = "property_name string, crawl_value string, suggested string, needs_review boolean, ord int"
EXISTING = "template string, language string, ord int, shared_id string, metadata string"
MESSAGES = "conv_id bigint, turn int, part_ord int, kind string, tool_name string, content string"
SUBTASKS = "subtask_id string, kind string, depends_on array<string>, status string"
PRIOR_SCRIPTS = "run_name string, kind string, task_summary string, subtask_description string, site_overview string, status string"

LINK_STATES = ("sample", "discovered", "processed")
DOWNLOAD_STATES = ("downloaded", "failed", "no_files", "load_failed")
VERDICTS = ("empty_pdf_url", "file_not_downloaded", "corrupt_file", "suspiciously_small", "present")
ACTIONS = ("CREATE", "CREATE_REGISTRY_ONLY", "UPDATE", "SKIP")
COVERAGE_FIELDS = ("subcategory", "year", "state")
