"""Event-time windows with state that is freed, and a ledger of the rows that come too late for it.

Two streams in a row. The first counts each batch of the log per window. A window that had closed before the batch (its end
is not after the newest event of the batches before, less the delay) goes to the ledger, the others go on. The second
stream sums those counts in Spark's state under a watermark that closes a window no sooner than the first stream does, so
it drops nothing. It advances once per batch of the first, within it, on exactly the counts of that batch. A window's
result is its summed state and its ledger rows, whatever the order of the files.

A batch that runs again after a failure finds its counts already written and does not write them again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.manifest import keep_last
from ..sources.tables import stored

REPORT = "batch long, rows long, newest timestamp, closed_before timestamp, late_counts long, state_rows long, dropped_rows long"


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


@dataclass(frozen=True)
class WindowRun:
    """Where one run keeps its counts, ledger, state, results and report."""

    spark: SparkSession
    folder: str
    schema: StructType
    keys: tuple[str, ...]
    width: timedelta
    delay: timedelta

    def late(self) -> DataFrame | None:
        """Counts of rows that came after their window had closed, a row per batch and window."""
        return stored(self.spark, f"{self.folder}/late")

    def report(self) -> DataFrame:
        """A row per batch: rows read, newest event, the time up to which windows had closed, counts that went to the ledger, rows of
        state after it, and rows that the state dropped (none, as late rows do not reach it)."""
        rows = stored(self.spark, f"{self.folder}/report")
        return self.spark.createDataFrame([], REPORT) if rows is None else rows.drop("part")

    def windows(self) -> DataFrame:
        """Every window over all rows read so far: the newest state of each, with its ledger rows added."""
        whole = self.spark.createDataFrame([], self.schema)
        for part in (self._newest(), self.late()):
            if part is not None:
                whole = whole.unionByName(part.select(*self.schema.names))
        return whole.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.schema.names if c not in self.keys])

    def _newest(self) -> DataFrame | None:
        updates = stored(self.spark, f"{self.folder}/result")
        return None if updates is None else keep_last(updates, list(self.keys), [F.col("batch").desc()])

    def _closed(self, batch: int) -> int | None:
        """Microseconds up to which windows had closed before a batch."""
        newest = self.report().filter(F.col("batch") < batch).agg(F.unix_micros(F.max("newest"))).first()[0]
        return None if newest is None else newest - _micros(self.delay)

    def add(self, batch: DataFrame, number: int, count: Callable[[DataFrame], DataFrame], ts: str) -> None:
        """Count one batch, put closed windows into the ledger, and advance the state by the others."""
        arrived, closed = f"{self.folder}/arrived/batch={number}", self._closed(number)
        if stored(self.spark, f"{arrived}/counts") is None:
            seen = Observation()
            counts = count(batch.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("newest")))
            late = F.lit(False) if closed is None else F.unix_micros("window_start") + _micros(self.width) <= closed
            counts.withColumn("_late", late).write.mode("overwrite").parquet(f"{arrived}/parts")
            facts = self.spark.createDataFrame([(number, seen.get["rows"], seen.get["newest"], closed)], "batch long, rows long, newest long, closed_before long")
            facts.withColumns({c: F.timestamp_micros(c) for c in ("newest", "closed_before")}).write.mode("overwrite").parquet(f"{arrived}/facts")
            parts = self.spark.read.parquet(f"{arrived}/parts")
            parts.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{self.folder}/late/batch={number}")
            parts.filter("not _late").drop("_late").write.mode("overwrite").parquet(f"{arrived}/counts")  # the last step: where it is, all is
        state_rows, dropped = self._advance()
        sums = [c for c in self.schema.names if c not in self.keys]
        late = self.spark.read.parquet(f"{self.folder}/late/batch={number}").agg(F.coalesce(F.sum(sums[-1] if "requests" not in sums else "requests"), F.lit(0)).cast("long")).first()[0]
        report = self.spark.read.parquet(f"{arrived}/facts").withColumns({n: F.lit(v).cast("long") for n, v in (("late_counts", late), ("state_rows", state_rows), ("dropped_rows", dropped))})
        report.write.mode("overwrite").parquet(f"{self.folder}/report/part={number}")

    def _advance(self) -> tuple[int, int]:
        """Sum the counts that the state has not seen yet; rows of state left, and rows dropped."""
        counts = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/arrived/batch=*/counts")
        marked = counts.withWatermark("window_start", f"{_micros(self.delay + self.width)} microseconds")
        sums = marked.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.schema.names if c not in self.keys])

        def update(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{self.folder}/result/batch={batch}")

        query = sums.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).foreachBatch(update).start()
        query.awaitTermination()
        states = [s for p in query.recentProgress for s in p["stateOperators"]]
        return (states[-1]["numRowsTotal"] if states else 0), sum(s["numRowsDroppedByWatermark"] for s in states)


def follow(stream: DataFrame, folder: str, count: Callable[[DataFrame], DataFrame], keys: Sequence[str], *, width: timedelta, delay: timedelta = timedelta(minutes=10), ts: str = "ts", **trigger) -> tuple[WindowRun, object]:
    """Follow a log; ``count`` gives sums per (window_start and other ``keys``) of a batch of it. The second value is the running query."""
    run = WindowRun(stream.sparkSession, folder, count(stream).schema, tuple(keys), width, delay)
    query = (
        stream.writeStream.option("checkpointLocation", f"{folder}/log")
        .foreachBatch(lambda batch, number: run.add(batch, number, count, ts))
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    return run, query


def run_windows(stream: DataFrame, folder: str, count: Callable[[DataFrame], DataFrame], keys: Sequence[str], **options) -> WindowRun:
    """Process everything that has landed."""
    run, query = follow(stream, folder, count, keys, **options)
    query.awaitTermination()
    return run
