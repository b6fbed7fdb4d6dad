"""What a session needs before a plan runs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


#: Rows of an Arrow batch on its way to Python: whole texts are long, and a batch lies in memory on both sides.
ARROW_ROWS = "500"


def ship(spark: SparkSession) -> SparkSession:
    """Hand the package to the executors, once per context: their Python need not have it installed. Arrow batches are made smaller unless the session sets them."""
    context, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # the default
        spark.conf.set(rows, ARROW_ROWS)
    if getattr(context, "_millrace_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="millrace-")
    archive = os.path.join(folder, "millrace_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(archive)
    context._millrace_shipped = True
    return spark


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that all executors share; below the warehouse where none is configured (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/millrace/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: a table in the shared folder, read back."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_stream(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its last result, written as a table to the shared folder."""
    spark, out, state = stream.sparkSession, shared_folder(stream.sparkSession, "stream"), shared_folder(stream.sparkSession, "stream-state")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
