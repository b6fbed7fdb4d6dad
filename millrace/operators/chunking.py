"""Chunk tables: texts and pages cut into overlapping pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import identity, text

STRATEGIES = ("recursive", "paragraph")
SNIPPET = 4000


def pieces(column: Column, most: int = 512, overlap: int = 50, strategy: str = "recursive") -> Column:
    """An array of chunk texts; overlap is added after the size was checked."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    if strategy == "recursive":
        return text.recursive_split(column, most, overlap)
    return text.with_overlap(text.paragraph_split(column, most), overlap)


def chunk(docs: DataFrame, content: str = "text", most: int = 512, overlap: int = 50, strategy: str = "recursive") -> DataFrame:
    """docs with source_id and path: one row per chunk, with chunk_id, content, chunk_index, total_chunks. Blank texts give none."""
    cut = docs.withColumn("__pieces", pieces(F.coalesce(F.col(content), F.lit("")), most, overlap, strategy))
    rows = cut.select(*[c for c in docs.columns if c not in (content, "content", "chunk_index", "total_chunks", "chunk_id")], F.size("__pieces").alias("total_chunks"), F.posexplode("__pieces").alias("chunk_index", "content"))
    return rows.withColumn("chunk_id", identity.chunk_id(F.col("source_id"), F.col("path"), F.col("chunk_index")))


def paged(docs: DataFrame, pages: str = "pages", content: str = "text") -> DataFrame:
    """One row per page for documents that have pages (their path names it), the document itself for others."""
    has = F.size(F.coalesce(F.col(pages), F.array().cast(docs.schema[pages].dataType))) > 0
    rest = [c for c in docs.columns if c not in (pages, content, "path")]
    by_page = docs.where(has).select(*rest, "path", F.explode(pages).alias("__p")).select(*rest, identity.page_path(F.col("path"), F.col("__p.index")).alias("path"), F.col("__p.text").alias(content))
    return by_page.unionByName(docs.where(~has).select(*rest, "path", content))


def chunk_extracted(docs: DataFrame, **options) -> DataFrame:
    """Chunks of extracted content; pages override the text."""
    return chunk(paged(docs), **options)
