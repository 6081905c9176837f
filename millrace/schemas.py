"""Schemas of the tables and of items on their way."""

ITEM = (
    "source_id long, pos int, guid string, url string, title string, author string, published_at timestamp, inferred_time boolean, "
    "summary string, content string, content_type string, tags array<string>, extra map<string,string>, fetched_at timestamp"
)
#: Items of landed documents also know their document; ``pos`` counts inside it.
DOCUMENT_ITEM = ITEM + ", doc_id string"
ENTRY = (
    "id long, source_id long, guid string, url string, content_hash string, title string, author string, published_at timestamp, summary string, "
    "content string, content_type string, tags array<string>, extra map<string,string>, fetched_at timestamp, created_at timestamp, updated_at timestamp, deleted boolean"
)
STATE = "entry_id long, read boolean, favorite boolean, archive boolean, read_later boolean, updated_at timestamp"
EVENT = "seq long, ts timestamp, entry_id long, flag string, value boolean"
SOURCE = (
    "id long, name string, type string, config string, interval int, enabled boolean, fail_count int, last_error string, created_at timestamp, updated_at timestamp, deleted boolean"
)
CURSOR = "source_id long, cursor string, updated_at timestamp"
FETCH_LOG = "id long, source_id long, started_at timestamp, elapsed_ms long, inserted int, skipped int, success boolean, error string"
RAW_DOC = "source_id long, doc_id string, base_url string, fetched_at timestamp, body string, etag string, last_modified string"

FLAGS = ("read", "favorite", "archive", "read_later")
