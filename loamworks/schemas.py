"""Schemas of the tables that operators pass on."""

from __future__ import annotations

TURNS = "array<struct<role: string, content: string>>"
#: All shapes of an extracted item side by side; a field is null where the item's shape lacks it.
ITEM_FIELDS = {
    "question": "string", "answer": "string", "rule": "string", "context": "string", "category": "string", "rationale": "string",
    "fact": "string", "topic": "string", "confidence": "string", "instruction": "string", "input": "string", "output": "string",
    "conversation": TURNS, "summary_type": "string", "original_text": "string", "summary": "string",
}
ITEM = "struct<" + ", ".join(f"{k}: {v}" for k, v in ITEM_FIELDS.items()) + ">"
METADATA = "struct<format: string, encoding: string, size_bytes: bigint, page_count: int, paragraph_count: int, table_count: int, title: string, author: string, subject: string, keywords: string>"
DOCUMENT = f"content string, metadata {METADATA}, source string"
LOCATION = "struct<file_path: string, page_number: int, line_start: int, line_end: int, char_start: int, char_end: int, section: string, chunk_index: int>"
