"""Declared schemas of the engine's relations."""

CORPORA = "resource_name string, display_name string, create_time timestamp, update_time timestamp"
EVENTS = "resource_name string, display_name string, event string, at timestamp, seq long"
FOLDERS = "folder_id string, name string, mime_type string, trashed boolean"
FILES = "file_id string, name string, mime_type string, content binary"
PARSED = "file_id string, status string, title string, content string, message string"
CHUNKS = "corpus_id string, doc_id string, uri string, title string, chunk_idx long, n_tokens long, chunk string"
