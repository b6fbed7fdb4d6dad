"""Streaming ingestion: deduplication, retries with growing waits, sinks by batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Seconds to wait after the first, second and third failure; later failures are final.
WAITS, MAX_RETRIES = (60, 300, 900), 3
DEDUP_TTL = "24 hours"


def read_json_lines(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 50) -> DataFrame:
    """A stream of JSON lines; lines that are no such object are marked by `_bad` and can be set aside."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return parse_json(lines, schema)


def parse_json(lines: DataFrame, schema: StructType, column: str = "value") -> DataFrame:
    """The other columns, the fields of a JSON text, whether it is no such object (`_bad`), and the text itself (`_raw`)."""
    parsed = lines.withColumn("__r", F.from_json(column, schema)).withColumn("_bad", F.col("__r").isNull() | (F.to_json("__r") == "{}"))
    return parsed.select(*[c for c in lines.columns if c != column], "__r.*", "_bad", F.col(column).alias("_raw"))


def to_messages(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One JSON text per row, beside the columns to keep; times in ISO form."""
    return df.select(*keep, F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}).alias("value"))


def rollup(rows: DataFrame, key: str, good: Column) -> DataFrame:
    """key, status: whether all, some or none of a key's rows are good."""
    return rows.groupBy(key).agg(F.when(F.bool_and(good), "all").when(F.bool_or(good), "some").otherwise("none").alias("status"))


def unique_within(stream: DataFrame, key: str, time: str, ttl: str = DEDUP_TTL) -> DataFrame:
    """Rows whose key was not seen within the time to live; state older than that is dropped."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def wait_seconds(retry_count: Column) -> Column:
    out = F.lit(None).cast("int")
    for k in reversed(range(len(WAITS))):
        out = F.when(retry_count == k, WAITS[k]).otherwise(out)
    return out


def drain(dead: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """dead: retry_count, failed_at and the original row. Rows to publish again (count + 1), rows still waiting, and final failures.

    A row waits by its own time of failure, so none holds up the rows behind it."""
    due = F.timestamp_seconds(F.unix_timestamp("failed_at") + wait_seconds(F.col("retry_count")))
    marked = dead.withColumn("retry_at", due)
    final = marked.where(F.col("retry_count") >= MAX_RETRIES)
    open_ = marked.where(F.col("retry_count") < MAX_RETRIES)
    again = open_.where(F.col("retry_at") <= as_of).withColumn("retry_count", F.col("retry_count") + 1).drop("retry_at")
    return again, open_.where(F.col("retry_at") > as_of), final


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Calls write(batch, id) for each micro-batch; a restart repeats at most the last one, so writes must be idempotent by id or key."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def latest_state(stream: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last row of each key, kept as state: an upsert as a streaming aggregation."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("row")).select(key, "row.*")


def backlog(progress: dict | None) -> int:
    """Rows that the last micro-batch found waiting, from a query's lastProgress."""
    return int((progress or {}).get("numInputRows") or 0)


def supervise(start: Callable[[], StreamingQuery], attempts: int | None = None, first: float = 1.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> None:
    """Keep a query running: after a failure it starts again from its checkpoint, waiting twice as long each time; a micro-batch that succeeds resets the wait."""
    wait, failures = first, 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return
        except StreamingQueryException:
            failures += 1
            if any((p.get("numInputRows") or 0) > 0 for p in query.recentProgress):
                wait = first
            if attempts is not None and failures >= attempts:
                raise
            sleep(wait)
            wait = min(2 * wait, longest)


def counted(df: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """df with an observation `name`: rows, and rows that meet each condition; read from the query's progress or an Observation."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
