"""Schemas of the engine's tables."""

from __future__ import annotations

CHUNK = "struct<index:int,char_start:int,text:string>"
CORPUS = "bucket string, external_id string, text string, metadata string, parent_doc_id string, chunk_index int, embedding array<float>"
HIT = "bucket string, id string, text string, metadata string, score double"
CHANGELOG = (
    "seq bigint, op string, bucket string, id string, text string, embedding array<float>, "
    "chunks array<struct<index:int,char_start:int,text:string,vector:array<float>>>, metadata string, home_epoch bigint"
)
#: Operations of the change log, as they are named in change events too.
OPS = ("insert", "insert_document", "delete", "delete_document", "empty_bucket")
