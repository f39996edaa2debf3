"""Study areas from GeoJSON, their info, and stored grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import shape_edges
from ..functions.numeric import as_col
from ..settings import Grid
from .tables import stored

_POSITIONS = "array<array<double>>"
_FEATURES = (
    "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
)


def _rings(kind: Column, coordinates: Column) -> Column:
    """Every ring of a polygon or multi-polygon as ``ARRAY<ARRAY<STRUCT<x,y>>>``."""
    single = F.from_json(coordinates, f"array<{_POSITIONS}>")
    multi = F.flatten(F.from_json(coordinates, f"array<array<{_POSITIONS}>>"))
    return F.transform(
        F.when(kind == "Polygon", single).otherwise(multi),
        lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))),
    )


def polygon_features(documents: DataFrame, text: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """First polygon feature of each GeoJSON document: ``rings``, ``edges`` and ``props``.

    A document without one fails the query.
    """
    parsed = documents.select(*keys, F.from_json(as_col(text), _FEATURES).alias("doc"))
    polygons = F.filter("doc.features", lambda f: f["geometry"]["type"].isin("Polygon", "MultiPolygon"))
    first = F.try_element_at(polygons, F.lit(1))
    found = parsed.withColumn("f", F.coalesce(first, F.raise_error(F.lit("the document has no polygon feature"))))
    rings = found.select(*keys, _rings(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("rings"), F.col("f.properties").alias("props"))
    return rings.withColumn("edges", shape_edges("rings"))


def read_areas(spark: SparkSession, path) -> DataFrame:
    """One row per GeoJSON file under ``path``, with the file as ``area_id``."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("area_id"), "value")
    return polygon_features(docs, keys=["area_id"])


def area_info(areas: DataFrame, *, keys: Sequence[str] = ("area_id",), rings: str = "rings", props: str = "props", grid: Grid = Grid()) -> DataFrame:
    """Bounding box and tile list: the list property (JSON list or comma text), the single-tile property, or the default."""
    vertices = F.flatten(F.col(rings))
    xs, ys = F.transform(vertices, lambda p: p["x"]), F.transform(vertices, lambda p: p["y"])
    listed = F.try_element_at(F.col(props), F.lit("sentinel2_mgrs_tiles"))
    single = F.try_element_at(F.col(props), F.lit("sentinel2_mgrs_tile"))
    as_list = F.from_json(listed, "array<string>")
    split = F.transform(F.split(listed, ","), lambda t: F.trim(t))
    tiles = (
        F.when((listed != "") & (listed != "[]"), F.when(listed.startswith("["), as_list).otherwise(split))
        .when(single != "", F.array(single))
        .otherwise(F.array(*map(F.lit, grid.default_tiles)))
    )
    return areas.select(
        *keys, F.array_min(xs).alias("min_lon"), F.array_min(ys).alias("min_lat"), F.array_max(xs).alias("max_lon"),
        F.array_max(ys).alias("max_lat"), tiles.alias("tiles"),
    )


def load_grid(spark: SparkSession, path: str, make) -> DataFrame:
    """The stored grid; ``make`` gives it the first time."""
    grid = stored(spark, path)
    if grid is None:
        make().write.parquet(path)
        grid = spark.read.parquet(path)
    return grid
