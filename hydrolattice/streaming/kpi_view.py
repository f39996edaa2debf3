"""KPIs per date kept up to date by signed counts.

Results are versions of (date, cell), an append per batch. A batch looks up the versions that it replaces, of its own dates
alone, and writes what changes: for each of its dates the parts of its rows less the parts of the rows they replace. The
KPIs of a date are its summed changes. No date is rebuilt and no result rewritten. Sums of readings are decimals, so a row
that is taken back leaves nothing behind. A batch that runs again finds only versions of earlier batches and writes the same places.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kpi import cell_parts, kpis_of_parts
from ..operators.manifest import keep_last
from ..settings import Grid
from ..sources.tables import stored

KEYS = ("date", "cell_id")


@dataclass(frozen=True)
class KpiView:
    """Result versions under ``results``, partitioned by date and batch, and changes per date and batch under ``changes``."""

    spark: SparkSession
    results: str
    changes: str
    grid: Grid = Grid()

    def current(self, dates: DataFrame | None = None, before: int | None = None) -> DataFrame | None:
        """The newest version of each (date, cell), of ``dates`` only and from batches ``before`` one, where these are given."""
        versions = stored(self.spark, self.results)
        if versions is None:
            return None
        if before is not None:
            versions = versions.filter(F.col("batch") < before)
        if dates is not None:
            versions = versions.join(dates.select("date").distinct(), "date", "left_semi")  # prunes partitions as it runs
        return keep_last(versions, list(KEYS), [F.col("batch").desc()]).drop("batch")

    def _parts(self, rows: DataFrame) -> DataFrame:
        parts = cell_parts(rows, vegetated=F.col("is_vegetated"), exact=True)
        return parts.withColumn("_cells", F.lit(1).cast("long"))

    def add(self, rows: DataFrame, number: int, order: Sequence = ()) -> None:
        """Take one batch of rows (date, cell_id, is_vegetated, class, priority, readings). Of rows that share date and cell within
        the batch the first by ``order`` counts."""
        one = keep_last(rows, list(KEYS), list(order) or [F.col("date")])
        one.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(self.results)
        fresh = stored(self.spark, self.results).filter(F.col("batch") == number).drop("batch")
        earlier = self.current(fresh, number)
        after = self._parts(fresh)
        names = [c for c in after.columns if c not in KEYS]
        signed = after if earlier is None else after.unionByName(
            self._parts(earlier.join(fresh.select(*KEYS), list(KEYS), "left_semi")).select(*KEYS, *[(-F.col(n)).alias(n) for n in names])
        )
        change = signed.groupBy("date").agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("decimal(38,12)" if n.startswith("_sum") else "long").alias(n) for n in names])
        change.write.mode("overwrite").parquet(f"{self.changes}/batch={number}")

    def kpis(self) -> DataFrame:
        """The KPIs of every date, from as many rows as batches touched it."""
        changes = stored(self.spark, self.changes)
        if changes is None:
            raise ValueError("no batch has been added")
        names = [c for c in changes.columns if c not in ("date", "batch")]
        return kpis_of_parts(changes.groupBy("date").agg(*[F.sum(n).alias(n) for n in names]), grid=self.grid)


def start(rows: DataFrame, view: KpiView, checkpoint: str, **trigger):
    """Keep the view over a stream of scored rows."""
    return (
        rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(view.add).trigger(**(trigger or {"availableNow": True})).start()
    )
