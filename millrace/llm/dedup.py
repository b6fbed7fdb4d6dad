"""Exact deduplication by a stateful stream.

Arrivals (digest, identifier, length, content locator; no text) flow through a streaming aggregation whose
keyed state lies on disk in RocksDB and never expires. The state keeps, per digest, the row that stays and a
count. Digests with more than one row are hits: their whole normalised bytes are compared, and a digest that
covers different texts is regrouped by the texts themselves. Everything runs on built-in expressions.

Defined results: a null text counts as empty; empty texts form a group; among equal texts the row with the most
code points stays, then the smallest doc_id (null last), then the first by content locator, so of fully repeated
rows exactly one stays (rows that are no plain scan are written first, so that each has a locator of its own); very
long texts are digested and compared whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WHITE, documents, free, located, materialise, place, scratch, small

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores of a run that has ended are closed soon, and their native memory is free
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # one store per partition: no 4 MB reserved in each
}


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def arrivals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One narrow row per document; file and row are the content locator."""
    text, (file, row) = F.coalesce(F.col(text_col), F.lit("")), place(docs)
    whole = [normalised(F.col(text_col)).alias("whole")] if with_text else []
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("digest"),
        F.length(text).alias("code_points"),
        file.alias("file"),
        row.alias("row"),
        *whole,
    )


def run_state(arrived: DataFrame, max_bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """Stream the arrivals table into RocksDB state and return the state: digest, group_size, stays."""
    spark = arrived.sparkSession
    path = arrived.inputFiles()[0].rsplit("/", 1)[0]
    state = scratch(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        seen = spark.readStream.schema(arrived.schema).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(path).groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(_rank()).alias("stays"))
        query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stored = spark.read.format("statestore").load(state)
    count, stays = stored.schema["value"].dataType.names
    return stored.select(F.col("key.digest").alias("digest"), F.col(f"value.`{count}`").alias("group_size"), F.col(f"value.`{stays}`").alias("stays"))


def _rank() -> Column:
    """The smallest of these stays."""
    return F.struct((-F.col("code_points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("file").alias("keep_file"), F.col("row").alias("keep_row"))


def differing(docs: DataFrame, hits: DataFrame, text_col: str = "text") -> DataFrame:
    """Digests under which the whole normalised bytes are not all the same. With hits that can be broadcast, texts are aggregated before they move, one row per group and task; beyond that all texts of hits are exchanged by their digests first."""
    bytes_ = docs.select(F.sha2(normalised(F.col(text_col)), 256).alias("digest"), normalised(F.col(text_col)).alias("whole"))
    return bytes_.join(hits, "digest", "left_semi").groupBy("digest").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, file, row: one row per input row."""
    docs = located(docs)
    arrived = materialise(arrivals(docs, id_col, text_col), "dedup-arrivals")
    state = run_state(arrived)
    hits = materialise(state.where("group_size > 1").select("digest"), "dedup-hits")
    clash = differing(docs, small(hits), text_col)
    out = arrived.join(state, "digest")
    if not clash.isEmpty():
        texts = _regrouped(docs, clash, id_col, text_col)
        out = out.join(clash, "digest", "left_anti").unionByName(texts)
    return out.select(
        "doc_id",
        F.col("stays.keep_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("file") == F.col("stays.keep_file")) & (F.col("row") == F.col("stays.keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "file",
        "row",
    )


def _regrouped(docs: DataFrame, clash: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The exact way for digests that cover different texts: group by the whole text."""
    rows = arrivals(docs, id_col, text_col, with_text=True).join(clash, "digest", "left_semi")
    groups = rows.groupBy("digest", "whole").agg(F.count(F.lit(1)).alias("group_size"), F.min(_rank()).alias("stays"))
    return rows.join(groups, ["digest", "whole"]).drop("whole")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns."""
    docs = located(docs)
    found = exact_dedup(docs, id_col, text_col)
    dropped = materialise(found.where(~F.col("kept")).select("file", "row"), "dedup-dropped")
    names, at = free(docs, "__file", "__row"), place(docs)
    rows = docs.select("*", *(c.alias(n) for c, n in zip(at, names, strict=True)))
    return rows.join(small(dropped.toDF(*names)), names, "left_anti").select(*docs.columns)


def op9(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
