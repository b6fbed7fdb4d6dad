"""Folders and object stores, read by Spark's own file readers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text, urls

MAX_BYTES = 25 << 20
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:/*|^/"


def files(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), max_bytes: int | None = MAX_BYTES, with_content: bool = False) -> DataFrame:
    """path (below root), modified, size and, if asked for, content. Without content only the listing is read.

    root may be any folder that Spark can list: local, s3a://, hdfs://."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = raw.select(_below(root).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), *([F.col("content")] if with_content else []))
    out = out.where(text.selected(F.col("path"), include, exclude))
    return out.where(F.col("size") <= max_bytes) if max_bytes is not None else out


def contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """path, content: the bytes of the named files below root, and no others.

    The paths are brought to the driver in parts of bounded size, as a file reader's list; other files are not opened."""
    wanted, out = paths.select("path").distinct(), None
    parts = max(1, -(-wanted.count() // PATHS))
    for k in range(parts):
        own = [r[0] for r in wanted.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == k).collect()]  # about PATHS names
        if own:
            raw = spark.read.format("binaryFile").load([inside(root, p).translate(_ESCAPED) for p in own])
            one = raw.select(_below(root).alias("path"), "content")
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "path string, content binary")


#: Paths that one reader gets; and signs that it would take for patterns.
PATHS = 10_000
_ESCAPED = str.maketrans({c: f"\\{c}" for c in "{}[]*?\\"})


def _below(root: str) -> Column:
    base = re.sub(_SCHEME, "/", root).rstrip("/") + "/"
    return F.substring(F.regexp_replace("path", _SCHEME, "/"), len(base) + 1, 1 << 20)


def objects(listing: DataFrame, prefix: str = "", include: Sequence[str] = (), exclude: Sequence[str] = (), max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """A bucket listing (key, modified, size, etag) as a snapshot: folder markers go, keys lose the prefix, etags their quotes."""
    out = listing.where(~F.col("key").endswith("/")).select(urls.relative_key(prefix, F.col("key")).alias("path"), "modified", "size", urls.bare_etag(F.col("etag")).alias("etag"))
    out = out.where(F.col("path") != "").where(text.selected(F.col("path"), include, exclude))
    return out.where(F.col("size") <= max_bytes) if max_bytes is not None else out


def inside(root: str, path: str) -> str:
    """The absolute path of a relative one; a ValueError if it leaves the root."""
    parts: list[str] = []
    for p in PurePosixPath(path).parts:
        if p == "..":
            if not parts:
                raise ValueError(f"{path!r} lies outside the source")
            parts.pop()
        elif p == "/":
            raise ValueError(f"{path!r} lies outside the source")
        elif p != ".":
            parts.append(p)
    return "/".join([root.rstrip("/"), *parts])
