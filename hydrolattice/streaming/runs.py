"""Running a stream over what has landed, with state and results in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import keep_last


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. On one machine a temporary one does where none is configured; a cluster needs it set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def new_run(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, run: str, keys: Sequence[str]) -> DataFrame:
    """Process everything that has landed, then return the newest row of each key of a windowed aggregate.

    Each batch writes only the windows it changed, in a folder of its own that a repeated batch replaces. The watermark
    frees the state of closed windows, and nothing rewrites their rows. Rows later than the watermark are lost.
    """
    spark = stream.sparkSession

    def update(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/result/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{run}/state")
        .trigger(availableNow=True).foreachBatch(update).start()
    )
    query.awaitTermination()
    updates = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{run}/result")
    return keep_last(updates, list(keys), [F.col("batch").desc()]).drop("batch")


def append_available(stream: DataFrame, run: str) -> DataFrame:
    """Process everything that has landed and return the windows closed by the watermark so far."""
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{run}/result")
        .option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{run}/result")
