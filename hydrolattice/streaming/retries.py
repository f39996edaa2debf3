"""Scenes that failed are tried again by themselves, after a delay that doubles with each failure.

Two streams meet per scene: rows of the catalogue and outcomes of earlier tries. A listed scene goes on at once and its row
is kept. A failure sets a timer, and when that runs out the kept row goes on again, without being listed again. Any other
outcome forgets the scene. State and timers are part of the checkpoint, so a delay goes on after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from .scenes import SceneWork, process_batch

SCENE = "scene_id string, acquired timestamp, cloud_cover double, tile string, baseline string"
OUTCOME = "scene_id string, status string, batch long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def retry_queue(first: float, longest: float) -> StatefulProcessor:
    """The processor of one scene's events; delays in seconds. The class travels by value, so executors need no copy of it."""
    row_kept = StructType.fromDDL(SCENE.split(", ", 1)[1]).add("tries", "long").add("seen", "long")
    row_due = StructType([StructField("at", LongType())])

    class RetryQueue(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.kept = handle.getValueState("kept", row_kept)  # the catalogue row, failures so far, and the batch of the last outcome
            self.due = handle.getValueState("due", row_due)

        def _forget_timer(self) -> None:
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
                self.due.clear()

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            rows = sorted(rows, key=lambda r: (r.status is not None, r.batch or 0))  # listings before outcomes
            listed = [r for r in rows if r.status is None]
            if listed:
                row = max(listed, key=lambda r: r.baseline or "")
                tries, seen = self.kept.get()[4:] if self.kept.exists() else (0, -1)
                self.kept.update((row.acquired, row.cloud_cover, row.tile, row.baseline, tries, seen))
                self._forget_timer()
                yield Row(scene_id=key[0], acquired=row.acquired, cloud_cover=row.cloud_cover, tile=row.tile, baseline=row.baseline)
            for r in rows:
                if r.status is None or not self.kept.exists() or r.batch <= self.kept.get()[5]:
                    continue  # an outcome that was read before
                if r.status != "failed":
                    self._forget_timer()
                    self.kept.clear()
                    continue
                row = self.kept.get()
                self.kept.update((*row[:4], row[4] + 1, r.batch))
                self._forget_timer()
                at = timerValues.getCurrentProcessingTimeInMs() + int(1000 * min(first * 2 ** row[4], longest))
                self.due.update((at,))
                self.handle.registerTimer(at)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            if self.kept.exists() and self.due.exists() and self.due.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
                self.due.clear()
                row = self.kept.get()
                yield Row(scene_id=key[0], acquired=row[0], cloud_cover=row[1], tile=row[2], baseline=row[3])

        def close(self) -> None:
            pass

    return RetryQueue()


def due_scenes(items: DataFrame, outcomes: DataFrame, *, first: float = 300.0, longest: float = 86_400.0) -> DataFrame:
    """Listed scenes as they come, and failed ones once their delay has run out."""
    listed = items.withColumns({"status": F.lit(None).cast("string"), "batch": F.lit(None).cast("long")})
    blank = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in SCENE.split(", ")[1:]}
    both = listed.unionByName(outcomes.withColumns(blank))
    return both.groupBy("scene_id").transformWithState(
        statefulProcessor=retry_queue(first, longest), outputStructType=StructType.fromDDL(SCENE), outputMode="Update", timeMode="ProcessingTime",
    )


def start(spark: SparkSession, items: DataFrame, folder: str, extract: SceneWork, default: date, *, first: float = 300.0, longest: float = 86_400.0, **trigger) -> StreamingQuery:
    """Follow a catalogue stream with retries. ``folder`` gets the scenes of each batch (``due``), the outcome log
    (``log``), ``features``, the outcomes that come back (``outcomes``) and the checkpoint. Timers need a trigger that goes on, such as ``processingTime``."""
    outcomes = f"{folder}/outcomes"
    spark.createDataFrame([], OUTCOME).write.mode("ignore").json(f"{outcomes}/batch=none")
    back = spark.readStream.schema(OUTCOME).json(f"{outcomes}/batch=*")

    def work(scenes: DataFrame, number: int) -> None:
        scenes.write.mode("overwrite").parquet(f"{folder}/due/batch={number}")  # the state is read once a batch
        due = spark.read.schema(SCENE).parquet(f"{folder}/due/batch={number}")
        if due.isEmpty():
            return
        process_batch(due, number, f"{folder}/log", f"{folder}/features", extract, default)
        done = spark.read.parquet(f"{folder}/log").filter(F.col("batch") == number)
        done.select("scene_id", "status", F.col("batch").cast("long").alias("batch")).write.mode("overwrite").json(f"{outcomes}/batch={number}")

    earlier = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # a query keeps the store that it starts with
    try:
        queue = due_scenes(items, back, first=first, longest=longest)
        return queue.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(work).trigger(**(trigger or {"processingTime": "1 minute"})).start()
    finally:
        spark.conf.set(_STORE, earlier)
