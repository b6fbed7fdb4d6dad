"""Routing: which extractor takes an event, what is skipped, and how attached content joins its parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import identity, text
from millrace.schemas import MAX_DEPTH

# What each extractor takes.
EXTRACTORS: dict[str, dict] = {
    "plain": {
        "mimes": ("text/plain", "text/markdown", "application/json", "text/yaml", "text/x-yaml", "text/csv", "text/tab-separated-values"),
        "extensions": ("txt", "md", "rst", "json", "yaml", "toml", "csv", "tsv", "log", "py", "js", "ts", "go", "rs", "java", "c", "cpp", "h", "sh"),
        "priority": 0,
    },
    "html": {"mimes": ("text/html", "application/xhtml+xml"), "extensions": ("html", "htm"), "priority": 20},
    "pdf-text": {"mimes": ("application/pdf",), "extensions": ("pdf",), "priority": 10},
    "office": {
        "mimes": (
            "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
            "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
            "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        ),
        "extensions": ("docx", "xlsx", "pptx"),
        "priority": 10,
    },
}


def capabilities(spark: SparkSession, extractors: dict[str, dict] = EXTRACTORS) -> DataFrame:
    """One row per MIME type or extension that an extractor takes: kind, value, extractor, priority."""
    rows = [(kind, v.lower().lstrip("."), name, e.get("priority", 0)) for name, e in extractors.items() for kind, vs in (("mime", e.get("mimes", ())), ("ext", e.get("extensions", ()))) for v in vs]
    return spark.createDataFrame(rows, "kind string, value string, extractor string, priority int")


def bare_mime(mime: Column) -> Column:
    """Without parameters, lower case; empty if unknown."""
    return F.lower(F.trim(F.get(F.split(F.coalesce(mime, F.lit("")), ";"), F.lit(0))))


def pick_extractor(events: DataFrame, caps: DataFrame, key: str = "event_id") -> DataFrame:
    """events with `extractor`: of all that match the MIME type or the extension, the highest priority, then the first name.

    caps is a registry of plugins, a table of dozens of rows."""
    best = caps.groupBy("kind", "value").agg(F.min(F.struct((-F.col("priority")).alias("p"), F.col("extractor").alias("e"))).alias("best"))
    by_mime = best.where("kind = 'mime'").select(F.col("value").alias("__mime"), F.col("best").alias("__by_mime"))
    by_ext = best.where("kind = 'ext'").select(F.col("value").alias("__ext"), F.col("best").alias("__by_ext"))
    out = events.withColumns({"__m": bare_mime(F.col("content_mime")), "__x": text.extension(F.col("path"))})
    out = out.join(F.broadcast(by_mime), F.col("__m") == F.col("__mime"), "left").join(F.broadcast(by_ext), F.col("__x") == F.col("__ext"), "left")
    return out.withColumn("extractor", F.least("__by_mime", "__by_ext")["e"]).drop("__m", "__x", "__mime", "__ext", "__by_mime", "__by_ext")


def route(events: DataFrame, caps: DataFrame, max_depth: int = MAX_DEPTH, text_fallback: bool = True) -> DataFrame:
    """events with extractor and route: control, delete, too_deep, image, no_content, extract or skip.

    With text_fallback, texts that no extractor names go to `plain` instead of being skipped."""
    out = pick_extractor(events, caps)
    fallback = F.when(F.col("modality") == "text", "plain") if text_fallback else F.lit(None).cast("string")
    out = out.withColumn("extractor", F.coalesce("extractor", fallback))
    control = F.col("type").eqNullSafe("trigger_sync") if "type" in events.columns else F.lit(False)
    missing = F.col("content_ref").isNull()
    decision = (
        F.when(control, "control")
        .when(F.col("operation") == "delete", "delete")
        .when(F.col("depth") >= max_depth, "too_deep")
        .when(F.col("modality") == "image", "image")
        .when(missing, "no_content")
        .when(F.col("extractor").isNull(), "skip")
        .otherwise("extract")
    )
    return out.withColumn("route", decision)


def valid_reference(ref: Column) -> Column:
    """Whether a reference carries what its kind needs."""
    kind = ref["kind"]
    return F.coalesce(
        F.when(kind == "path", ref["path"].isNotNull())
        .when(kind == "inline_bytes", ref["bytes_b64"].isNotNull())
        .when(kind == "inline_text", ref["text"].isNotNull())
        .when(kind == "url", ref["url"].isNotNull())
        .when(kind == "object_storage", ref["bucket"].isNotNull() & ref["key"].isNotNull()),
        F.lit(False),
    )


def fetch_inline(ref: Column) -> Column:
    """Bytes of references that carry them; null for those that a reader must fetch."""
    return F.when(ref["kind"] == "inline_bytes", F.unbase64(ref["bytes_b64"])).when(ref["kind"] == "inline_text", ref["text"].cast("binary"))


def fetch_paths(events: DataFrame, files: DataFrame, most: int | None = None) -> DataFrame:
    """events with content: inline, or joined from files (path, length, content); a file too large gives empty bytes."""
    body = F.when(F.col("length") > most, F.lit(b"")).otherwise(F.col("content")) if most else F.col("content")
    found = files.select(F.col("path").alias("__file"), body.alias("__content"))
    return events.join(found, F.col("content_ref.path") == F.col("__file"), "left").withColumn("content", F.coalesce(fetch_inline(F.col("content_ref")), "__content")).drop("__file", "__content")


def attach(children: DataFrame, parents: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """children (with parent_event_id) take a blank source from their parent, lie one level deeper and get a new key; too deep ones are dropped."""
    up = parents.select(F.col("event_id").alias("parent_event_id"), F.col("source_id").alias("__id"), F.col("source_type").alias("__type"), F.col("depth").alias("__depth"))
    out = children.drop("depth", "idempotency_key").join(up, "parent_event_id")
    out = out.withColumns({"source_id": F.coalesce(F.nullif("source_id", F.lit("")), "__id"), "source_type": F.coalesce(F.nullif("source_type", F.lit("")), "__type"), "depth": F.col("__depth") + 1})
    out = out.withColumn("idempotency_key", identity.idempotency_key(F.col("source_id"), F.col("path"), F.col("content_hash"), F.col("modality")))
    return out.where(F.col("depth") < max_depth).drop("__id", "__type", "__depth")


def unprocessed(events: DataFrame, done: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Events whose key is new, one of each."""
    return events.join(done.select(key), key, "left_anti").dropDuplicates([key])


def dispatch_batches(counts: Sequence[int], limit: int) -> list[list[int]]:
    """Groups of neighbouring jobs of at most limit chunks in sum."""
    out: list[list[int]] = []
    held = 0
    for k, n in enumerate(counts):
        if out and held + n <= limit:
            out[-1].append(k)
            held += n
        else:
            out.append([k])
            held = n
    return out


def legacy_text(modality: Column, ocr_text: Column, path: Column) -> Column:
    """The text of an event that carries no content: what was recognised, else a placeholder."""
    return F.when(modality == "text", F.coalesce(F.nullif(ocr_text, F.lit("")), F.concat(F.lit("[file: "), path, F.lit("]"))))


def rank_candidates(rows: DataFrame, key: str) -> DataFrame:
    """All matching extractors in order: for diagnosis."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("priority"), "extractor")))
