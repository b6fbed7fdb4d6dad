"""Identifiers, equal bit for bit wherever they are computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idempotency_key(source_id: Column, path: Column, content_hash: Column, modality: Column) -> Column:
    """Operation and commit are left out on purpose: the same content of a path has one key."""
    return F.sha2(F.concat_ws(":", source_id, path, F.coalesce(content_hash, F.lit("")), modality), 256)


def version_key(key: Column, operation: Column, commit: Column) -> Column:
    """Apart for every operation and version, so that a second delete or a reverted change is no duplicate."""
    return F.sha2(F.concat_ws(":", key, operation, F.coalesce(commit, F.lit(""))), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(source_id: Column, path: Column, index: Column) -> Column:
    return F.concat_ws(":", source_id, path, index.cast("string"))


def page_path(path: Column, page: Column) -> Column:
    return F.concat(path, F.lit("#page="), page.cast("string"))


def base_path(path: Column) -> Column:
    """The document of a page path."""
    return F.regexp_replace(path, "#page=[0-9]+$", "")


def point_id(chunk: Column) -> Column:
    """The first 16 hex digits of the digest as an unsigned number: beyond a signed 64-bit one, hence a decimal."""
    return F.conv(F.substring(F.md5(chunk), 1, 16), 16, 10).cast("decimal(20,0)")


def lexical_id(chunk: Column) -> Column:
    return F.md5(chunk)


def cache_key(extractor: Column, version: Column, hash_: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", extractor, version, hash_), 256), 1, 32)


def short_source_id(kind: str, unique: Column) -> Column:
    """`src-<kind>-` and six hex digits of a unique text that the caller supplies."""
    return F.concat(F.lit(f"src-{kind}-"), F.substring(F.regexp_replace(unique, "-", ""), 1, 6))
