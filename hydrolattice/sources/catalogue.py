"""Landed scene-catalogue items and band-file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scene_names import path_date, path_scene, scene_tile

ITEM_SCHEMA = (
    "id string, properties struct<datetime:string, `eo:cloud_cover`:double, `s2:high_proba_clouds_percentage`:double, "
    "`s2:mgrs_tile`:string, `s2:processing_baseline`:string>"
)


def scene_items(items: DataFrame) -> DataFrame:
    """(scene_id, acquired, cloud_cover, tile, baseline) with the property fallbacks."""
    p = F.col("properties")
    return items.select(
        F.col("id").alias("scene_id"),
        F.to_timestamp(p["datetime"]).alias("acquired"),
        F.coalesce(p["eo:cloud_cover"], p["s2:high_proba_clouds_percentage"], F.lit(100.0)).alias("cloud_cover"),
        scene_tile(p["s2:mgrs_tile"], F.col("id")).alias("tile"),
        p["s2:processing_baseline"].alias("baseline"),
    )


def read_items(spark: SparkSession, path) -> DataFrame:
    return scene_items(spark.read.schema(ITEM_SCHEMA).json(path))


def list_band_files(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """(scene_dir, date, scene_id, band, length) of band files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    folder = F.element_at(parts, -2)
    return files.select(
        folder.alias("scene_dir"), path_date(folder).alias("date"), path_scene(folder).alias("scene_id"),
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("band"), "length",
    )


def with_path_columns(df: DataFrame) -> DataFrame:
    """Date and scene read from the folder of the file a row came from."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.select("*", path_date(folder).cast("date").alias("date"), path_scene(folder).alias("scene_id"))
