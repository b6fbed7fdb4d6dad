"""Change detection: two snapshots in, change events out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import identity, text

GIT_OPERATIONS = {"A": "add", "M": "modify", "D": "delete", "R": "rename"}


def snapshot_diff(current: DataFrame, previous: DataFrame, key: str = "path", compare: tuple[str, ...] = ("modified", "size"), etag: str | None = None) -> DataFrame:
    """key, operation (add, modify, delete) and the current columns. An etag counts only where the current one is known."""
    old = previous.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in (*compare, *([etag] if etag else []))), F.lit(True).alias("__old"))
    both = current.withColumn("__new", F.lit(True)).join(old, F.col(key) == F.col("__key"), "full_outer")
    changed = F.lit(False)
    for c in compare:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    if etag:
        changed = changed | (F.col(etag).isNotNull() & ~F.col(etag).eqNullSafe(F.col(f"__{etag}")))
    operation = F.when(F.col("__old").isNull(), "add").when(F.col("__new").isNull(), "delete").when(changed, "modify")
    named = both.withColumn("operation", operation).where("operation is not null").withColumn(key, F.coalesce(key, "__key"))
    return named.select(*current.columns, "operation")


def next_snapshot(current: DataFrame, previous: DataFrame, failed: DataFrame, key: str = "path") -> DataFrame:
    """What to compare with next time: the current rows, but for failed keys the previous ones, so that they are tried again."""
    kept = previous.join(failed.select(key), key, "left_semi")
    return current.join(failed.select(key), key, "left_anti").unionByName(kept, allowMissingColumns=True)


def git_status(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines of `--name-status`: operation, path, old_path. Other markers are dropped."""
    parts = F.split(column, "\t")
    mark = F.substring(F.get(parts, F.lit(0)), 1, 1)
    operation = F.lit(None).cast("string")
    for k, v in GIT_OPERATIONS.items():
        operation = F.when(mark == k, v).otherwise(operation)
    path = F.when((mark == "R") & (F.size(parts) >= 3), F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    old = F.when((mark == "R") & (F.size(parts) >= 3), F.get(parts, F.lit(1)))
    return lines.select(*[c for c in lines.columns if c != column], operation.alias("operation"), path.alias("path"), old.alias("old_path")).where("operation is not null and path is not null")


def split_renames(events: DataFrame) -> DataFrame:
    """A rename as the deletion of the old path and the addition of the new one, so that nothing stale stays."""
    rename = F.array(F.struct(F.lit("delete").alias("operation"), F.col("old_path").alias("path")), F.struct(F.lit("add").alias("operation"), F.col("path").alias("path")))
    same = F.array(F.struct(F.col("operation"), F.col("path")))
    rest = [c for c in events.columns if c not in ("operation", "path", "old_path")]
    return events.select(*rest, F.explode(F.when((F.col("operation") == "rename") & F.col("old_path").isNotNull(), rename).otherwise(same)).alias("__e")).select(*rest, "__e.operation", "__e.path")


def fetch_changes(fetches: DataFrame, key: str = "url", at: str = "fetched_at", hash_: str = "content_hash", failed: Column | None = None) -> DataFrame:
    """Fetches of pages over time: add at first sight, modify where the hash differs from the fetch before; never delete."""
    good = fetches.where(~failed) if failed is not None else fetches
    before = F.lag(hash_).over(Window.partitionBy(key).orderBy(at))
    operation = F.when(F.row_number().over(Window.partitionBy(key).orderBy(at)) == 1, "add").when(~F.col(hash_).eqNullSafe(before), "modify")
    return good.withColumn("operation", operation).where("operation is not null")


def events(changes: DataFrame, source_id: str, source_type: str, as_of: Column) -> DataFrame:
    """Change events from changes (path, operation and, where known, content_hash, size, modified). Deletions have no hash."""
    have = set(changes.columns)
    hash_ = F.when(F.col("operation") != "delete", F.col("content_hash")) if "content_hash" in have else F.lit(None).cast("string")
    out = changes.withColumns({"source_id": F.lit(source_id), "source_type": F.lit(source_type), "modality": text.adapter_modality(F.col("path")), "content_hash": hash_})
    return out.withColumns(
        {
            "idempotency_key": identity.idempotency_key(F.col("source_id"), F.col("path"), F.col("content_hash"), F.col("modality")),
            "timestamp": as_of,
            "retry_count": F.lit(0),
            "depth": F.lit(0),
            "priority": F.lit("cron"),
            "content_modified_at": F.col("modified") if "modified" in have else F.lit(None).cast("timestamp"),
        }
    )


def changed_content(changes: DataFrame, content: DataFrame, key: str = "path") -> DataFrame:
    """Bytes only for what was added or modified: the listing is compared first, and content is joined to the few rows left."""
    return changes.where(F.col("operation").isin("add", "modify")).join(content.select(key, "content"), key, "left").withColumn("content_hash", identity.content_hash(F.col("content")))


def inline_reference(content: Column, url: Column, most: int = 1 << 20) -> Column:
    """Small payloads travel as base64, others by URL."""
    small = F.octet_length(content) < most
    return F.struct(F.when(small, "inline_bytes").otherwise("url").alias("kind"), F.when(small, F.base64(content)).alias("bytes_b64"), F.when(~small, url).alias("url"))


def last_commit(commits: DataFrame) -> DataFrame:
    """commits: path, committed_at. The last time per path."""
    return commits.groupBy("path").agg(F.max("committed_at").alias("content_modified_at"))


def distinct_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def of_unknown_sources(rows: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows whose source is not registered."""
    return rows.join(sources.select(key).distinct(), key, "left_anti").select(*rows.columns)
