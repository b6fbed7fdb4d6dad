"""Schemas of the tables that the engine reads and keeps."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


OPERATIONS = ("add", "modify", "delete", "rename")
MODALITIES = ("text", "image")
EMBEDDED_MODALITIES = ("text", "image", "audio_transcript", "video_transcript")
PRIORITIES = ("manual", "webhook", "cron")
SOURCE_STATES = ("idle", "detecting", "preprocessing", "indexing", "error")
CONTENT_KINDS = ("path", "inline_bytes", "inline_text", "url", "object_storage")
MAX_DEPTH = 3
TEXT_DIMENSIONS, IMAGE_DIMENSIONS = 768, 512

CONTENT_REF = _struct(kind=_S, path=_S, bytes_b64=_S, text=_S, url=_S, bucket=_S, key=_S)
PAGE = _struct(index=_I, text=_S, title=_S)

CHANGE_EVENT = _struct(
    event_id=_S, idempotency_key=_S, source_id=_S, source_type=_S, operation=_S, path=_S, old_path=_S, modality=_S, content_hash=_S,
    size_bytes=_L, priority=_S, commit_sha=_S, timestamp=_TS, retry_count=_I, content_modified_at=_TS, content_ref=CONTENT_REF,
    content_mime=_S, depth=_I,
)
EXTRACTED = _struct(
    source_event_id=_S, text=_S, pages=T.ArrayType(PAGE), structure=T.MapType(_S, _S), metadata=T.MapType(_S, _S),
    extractor_id=_S, extractor_version=_S, error=_S,
)
CHUNK = _struct(chunk_id=_S, content=_S, path=_S, repo=_S, source_id=_S, chunk_index=_I, total_chunks=_I, content_modified_at=_TS)
EMBEDDED = _struct(
    chunk_id=_S, vector=T.ArrayType(T.FloatType()), model=_S, modality=_S, path=_S, repo=_S, source_id=_S, derived_from=_S,
    snippet=_S, content_modified_at=_TS,
)
SOURCE = _struct(
    source_id=_S, type=_S, name=_S, url=_S, branch=_S, folder_path=_S, status=_S, last_sync=_TS, indexed_files=_L, pending_jobs=_L,
    sync_cron=_S, file_patterns=T.ArrayType(_S),
)
LISTING = _struct(path=_S, modified=_TS, size=_L, etag=_S)
