"""A cache of scene features by scene and feature version, with snapshots.

A commit writes its features into a folder of its own, then a snapshot: all scenes, each with its status, its feature version
and the commit that holds its rows. A pointer of one row to the snapshot is made last, so a reader sees features and
statuses of the same commits or none of a commit. What a commit wrote before it failed is named by no snapshot, and the
next commit takes another folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import latest_copies, scene_completeness, usable_scenes
from ..settings import BANDS, Scenes
from .tables import stored

SNAPSHOT = "scene_id string, version string, status string, cells long, acquisition_date date, commit string"


@dataclass(frozen=True)
class SceneCache:
    spark: SparkSession
    root: str

    def _newest(self) -> int | None:
        """The newest snapshot that is whole."""
        heads = stored(self.spark, f"{self.root}/heads")
        return None if heads is None else heads.agg(F.max("sequence")).first()[0]

    def snapshot(self, sequence: int | None = None) -> DataFrame:
        """The scenes of a snapshot, of the newest one by default."""
        at = self._newest() if sequence is None else sequence
        if at is None:
            return self.spark.createDataFrame([], SNAPSHOT)
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/snapshots/sequence={at}")

    def features(self, sequence: int | None = None) -> DataFrame | None:
        """The rows of all complete scenes of a snapshot. The join prunes the folders of commits that it does not name."""
        rows = stored(self.spark, f"{self.root}/features")
        if rows is None:
            return None
        scenes = self.snapshot(sequence).filter("status = 'complete'").select("scene_id", "commit")
        return rows.filter(~F.col("failed")).join(scenes, ["scene_id", "commit"], "left_semi").drop("commit", "failed")

    def missing(self, scenes: DataFrame, version: str) -> DataFrame:
        """The scenes that have no lasting outcome of this feature version: new ones, failed ones and incomplete ones."""
        done = self.snapshot().filter((F.col("version") == version) & ~F.col("status").isin("failed", "incomplete"))
        return scenes.join(done.select("scene_id"), "scene_id", "left_anti")

    def commit(self, scenes: DataFrame, features: DataFrame, version: str) -> int:
        """Add outcomes of ``scenes`` (scene_id, acquisition_date, and a status where it is known) with their ``features``.

        Of the others, a scene with a ``failed`` row is ``failed``, one without rows ``no_clear_cells``, the rest ``complete``. Scenes
        of earlier commits stay unless they come again. Gives the number of the snapshot.
        """
        name, before = uuid.uuid4().hex, self._newest()
        sequence = 0 if before is None else before + 1
        flagged = features if "failed" in features.columns else features.withColumn("failed", F.lit(False))
        flagged.hint("rebalance", F.col("scene_id")).write.parquet(f"{self.root}/features/commit={name}")
        self._write_snapshot(scenes, version, name, sequence)
        self._point(sequence)
        return sequence

    def _write_snapshot(self, scenes: DataFrame, version: str, name: str, sequence: int) -> None:
        rows = self.spark.read.parquet(f"{self.root}/features/commit={name}").groupBy("scene_id").agg(F.count_if(~F.col("failed")).alias("cells"), F.max("failed").alias("_failed"))
        given = F.col("status") if "status" in scenes.columns else F.lit(None).cast("string")
        outcome = F.when(F.col("_failed"), "failed").when(F.col("cells") > 0, "complete").otherwise("no_clear_cells")
        fresh = scenes.join(rows, "scene_id", "left").select(
            "scene_id", F.lit(version).alias("version"), F.coalesce(given, outcome).alias("status"), F.coalesce("cells", F.lit(0)).cast("long").alias("cells"),
            F.col("acquisition_date").cast("date").alias("acquisition_date"), F.lit(name).alias("commit"),
        )
        earlier = self.snapshot().select(*fresh.columns).join(fresh.select("scene_id"), "scene_id", "left_anti")
        earlier.unionByName(fresh).write.mode("overwrite").parquet(f"{self.root}/snapshots/sequence={sequence}")

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """A table kept in the cache's folder, for what several steps of a commit read. No snapshot names it."""
        path = f"{self.root}/staged/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _point(self, sequence: int) -> None:
        self.spark.range(1).select(F.lit(sequence).cast("long").alias("sequence")).coalesce(1).write.mode("append").parquet(f"{self.root}/heads")


def ingest(cache: SceneCache, scenes: DataFrame, files: DataFrame, extract: Callable[[DataFrame], DataFrame], version: str, settings: Scenes = Scenes(), *, tiles: Sequence[str] = (), bands: Sequence[str] = BANDS) -> int:
    """Catalogue to cache in one step: usable scenes in their latest copies, whole on disk, not yet in the cache in this version.

    ``scenes`` has (scene_id, acquired, cloud_cover, tile, baseline), ``files`` (scene_id, band, length). Scenes with missing or short
    band files are ``incomplete`` and come again with the next run. The scenes to do are worked out once and kept, and only their
    files are looked at.
    """
    usable = usable_scenes(scenes, settings, tiles=tiles, start=settings.start, end=settings.end)
    spot = F.coalesce("tile", F.concat(F.lit("scene "), "scene_id"))
    newest = latest_copies(usable.withColumns({"acquisition_date": F.to_date("acquired"), "_spot": spot}), keys=["acquisition_date", "_spot"], baseline="baseline", sequence=["scene_id"]).drop("_spot")
    missing = cache.staged(cache.missing(newest, version), "missing")
    whole = scene_completeness(files.join(missing.select("scene_id"), "scene_id", "left_semi"), scene="scene_id", bands=bands, min_bytes=settings.min_band_bytes)
    todo = cache.staged(missing.join(whole, "scene_id", "left").withColumn("status", F.when(~F.coalesce("complete", F.lit(False)), "incomplete")).drop("complete"), "todo")
    return cache.commit(todo.select("scene_id", "acquisition_date", "status"), extract(todo.filter("status is null").drop("status")), version)
