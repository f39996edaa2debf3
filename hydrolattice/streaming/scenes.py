"""Incremental scene processing."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.manifest import keep_last, latest_copies
from ..sources.tables import stored, write_parquet

SceneWork = Callable[[DataFrame], DataFrame]


def manifest_of(log: DataFrame) -> DataFrame:
    """Latest record per scene of an append-only outcome log."""
    return keep_last(log, "scene_id", [F.col("batch").desc()]).drop("batch")


def _place(scene_id, tile):
    """What copies of one scene share on a day: their tile, or the scene alone where the tile is unknown."""
    return F.coalesce(tile, F.concat(F.lit("scene "), scene_id))


def scenes_to_process(scenes: DataFrame, manifest: DataFrame | None, default: date) -> DataFrame:
    """The latest copy of each (day, tile) from ``default`` on that is neither complete nor older than a complete copy.

    Failed scenes come again whenever they are listed again, however old they are. Scenes without a tile are never copies
    of one another.
    """
    placed = scenes.filter(F.to_date("acquired") >= F.lit(default)).withColumns({"_day": F.to_date("acquired"), "_spot": _place(F.col("scene_id"), F.col("tile"))})
    found = latest_copies(placed, keys=["_day", "_spot"], baseline="baseline", sequence=["scene_id"])
    if manifest is not None:
        done = manifest.filter(F.col("status") == "complete")
        found = found.join(done.select("scene_id"), "scene_id", "left_anti")
        newest = done.groupBy(F.col("acquisition_date").alias("_day"), _place(F.col("scene_id"), F.col("mgrs_tile")).alias("_spot")).agg(F.max("baseline").alias("_done"))
        found = found.join(newest, ["_day", "_spot"], "left").filter(F.col("_done").isNull() | (F.col("baseline") > F.col("_done"))).drop("_done")
    return found.drop("_day", "_spot")


def process_batch(scenes: DataFrame, batch_id: int, log_path: str, features_path: str, extract: SceneWork, default: date) -> None:
    """Extract the features of scenes that are not complete yet, then log every outcome.

    ``extract`` returns features with ``scene_id``; a scene it gives no row for is ``no_clear_cells``, and one
    whose ``failed`` column is true is ``failed``, to be tried again by a later batch. Outcomes are a partition
    per batch and features a partition per scene, so a batch that is run again writes the same places.
    """
    log = stored(scenes.sparkSession, log_path)
    found = scenes_to_process(scenes, None if log is None else manifest_of(log.filter(F.col("batch") < batch_id)), default)
    features = extract(found)
    if "failed" not in features.columns:
        features = features.withColumn("failed", F.lit(False))
    features = features.persist()  # written and counted
    write_parquet(features.filter(~F.col("failed")).drop("failed"), features_path, ["scene_id"], replace_partitions=True)
    outcome = features.groupBy("scene_id").agg(F.count_if(~F.col("failed")).alias("cells"), F.max("failed").alias("_failed"))
    records = found.join(outcome, "scene_id", "left").select(
        "scene_id",
        F.to_date("acquired").alias("acquisition_date"),
        F.col("tile").alias("mgrs_tile"),
        F.round("cloud_cover", 2).alias("cloud_cover_pct"),
        F.coalesce("cells", F.lit(0)).cast("int").alias("cells"),
        F.when(F.col("_failed"), "failed").when(F.col("cells") > 0, "complete").otherwise("no_clear_cells").alias("status"),
        "baseline",
        F.lit(batch_id).cast("long").alias("batch"),
    )
    write_parquet(records, log_path, ["batch"], replace_partitions=True)
    features.unpersist()


def start(items: DataFrame, log_path: str, features_path: str, checkpoint: str, extract: SceneWork, default: date, **trigger) -> StreamingQuery:
    """Follow a stream of catalogue rows. The outcome log decides what is done, so a failed scene that is listed again is
    tried again, and old scenes that are listed late are taken too."""
    return (
        items.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: process_batch(batch, number, log_path, features_path, extract, default))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def item_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)
