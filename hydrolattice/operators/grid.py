"""Regular cell grids, weather lattices and canal reaches over study areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geodesy import from_utm, to_utm
from ..functions.geometry import box_meets_shape, contains_point, edge_distance, edges_between
from ..functions.numeric import as_col, round_even
from .ordering import ranked
from .partitioning import spread


def projected_rings(areas: DataFrame, rings: str = "rings", central_meridian: float = 75.0) -> DataFrame:
    """Rings of lon/lat vertices turned into metres."""
    def vertex(p):
        east, north = to_utm(p["x"], p["y"], central_meridian)
        return F.struct(east.alias("x"), north.alias("y"))

    return areas.withColumn(rings, F.transform(rings, lambda ring: F.transform(ring, vertex)))


def with_bounds(areas: DataFrame, edges: str = "edges") -> DataFrame:
    """Bounding box of each shape."""
    def ends(axis: str):
        return F.flatten(F.transform(edges, lambda e: F.array(e[f"{axis}1"], e[f"{axis}2"])))

    return areas.withColumns({
        "minx": F.array_min(ends("x")), "maxx": F.array_max(ends("x")),
        "miny": F.array_min(ends("y")), "maxy": F.array_max(ends("y")),
    })


def spatial_grid(
    areas: DataFrame,
    *,
    area_id: str = "area_id",
    edges: str = "edges",
    cell_size: float = 250.0,
    id_prefix: str = "CELL",
    central_meridian: float | None = 75.0,
) -> DataFrame:
    """Cells of every area that meet its shape, numbered column by column over the kept cells, area after area.

    Columns of a grid are spread over tasks before their cells are made, each with only the edges that
    reach into it, so one large area does not stay in one task. Numbers are in-column ranks plus a prefix sum over column counts.
    ``central_meridian=None`` leaves the centroid in the grid's own coordinates.
    """
    size = F.lit(float(cell_size))

    def count_along(low: str, high: str):
        return F.ceil((F.col(high) - F.col(low)) / size)

    boxed = with_bounds(areas.select(area_id, F.col(edges).alias("edges")))
    columns = boxed.filter((F.col("maxx") > F.col("minx")) & (F.col("maxy") > F.col("miny"))).withColumn(
        "ix", F.explode(F.sequence(F.lit(0).cast("long"), count_along("minx", "maxx") - 1))
    )
    left = F.col("minx") + F.col("ix") * size
    columns = spread(columns.withColumn("edges", edges_between("edges", "x", left, left + size)), area_id, "ix")
    cells = columns.withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), count_along("miny", "maxy") - 1)))
    x, y = F.col("minx") + F.col("ix") * size, F.col("miny") + F.col("iy") * size
    kept = cells.filter(box_meets_shape("edges", x, y, x + size, y + size)).select(
        area_id, "ix", "iy", x.alias("cell_minx"), y.alias("cell_miny"), (x + size).alias("cell_maxx"), (y + size).alias("cell_maxy")
    )
    in_column = Window.partitionBy(area_id, "ix")
    numbered = kept.withColumn("_at", F.row_number().over(in_column.orderBy("iy")))
    along = Window.partitionBy(area_id).orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    per_column = kept.groupBy(area_id, "ix").agg(F.count(F.lit(1)).alias("_n"))
    # Numbers go on from area to area, so an id names one cell of the whole table. This window holds one row per area.
    earlier = Window.partitionBy(F.lit(0)).orderBy(area_id).rowsBetween(Window.unboundedPreceding, -1)
    per_area = per_column.groupBy(area_id).agg(F.sum("_n").alias("_n")).select(area_id, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    before = per_column.join(per_area, area_id).select(
        area_id, "ix", (F.coalesce(F.sum("_n").over(along), F.lit(0)) + F.col("_first")).alias("_before")
    )
    middle_x, middle_y = (F.col("cell_minx") + F.col("cell_maxx")) / 2, (F.col("cell_miny") + F.col("cell_maxy")) / 2
    if central_meridian is not None:
        middle_x, middle_y = from_utm(middle_x, middle_y, central_meridian)
    return numbered.join(before, [area_id, "ix"]).select(
        area_id,
        F.format_string(f"{id_prefix}_%04d", F.col("_at") + F.col("_before")).alias("cell_id"),
        "ix", "iy",
        F.col("cell_minx").alias("minx"), F.col("cell_miny").alias("miny"),
        F.col("cell_maxx").alias("maxx"), F.col("cell_maxy").alias("maxy"),
        round_even(middle_x, 5).alias("centroid_lon"), round_even(middle_y, 5).alias("centroid_lat"),
    )


def weather_lattice(
    areas: DataFrame,
    *,
    area_id: str = "area_id",
    edges: str = "edges",
    spacing: float = 0.1,
    id_prefix: str = "WX",
) -> DataFrame:
    """Spacing-aligned points inside an area or less than half a spacing from its edge, numbered row by row."""
    step = F.lit(float(spacing))

    def along(low: str, high: str):
        return F.sequence(F.floor(F.col(low) / step), F.ceil(F.col(high) / step))

    boxed = with_bounds(areas.select(area_id, F.col(edges).alias("edges")))
    rows = boxed.withColumn("_row", F.explode(along("miny", "maxy")))
    lon, lat = F.col("_col") * step, F.col("_row") * step
    rows = spread(rows.withColumn("edges", edges_between("edges", "y", lat - step / 2, lat + step / 2)), area_id, "_row")
    places = rows.withColumn("_col", F.explode(along("minx", "maxx")))
    near = contains_point("edges", lon, lat) | F.coalesce(edge_distance("edges", lon, lat) < step / 2, F.lit(False))
    kept = places.filter(near).select(area_id, "_row", "_col", lon.alias("_lon"), lat.alias("_lat"))
    return ranked(kept, [area_id], ["_row", "_col"], "_number", "points").select(
        area_id,
        F.format_string(f"{id_prefix}_%03d", F.col("_number") - 1).alias("weather_point_id"),
        round_even("_lat", 4).alias("latitude"),
        round_even("_lon", 4).alias("longitude"),
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when a table is empty."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def equal_width_bands(df: DataFrame, value: str, labels: tuple[str, ...] = ("head", "middle", "tail"), output: str = "reach") -> DataFrame:
    """Equal-width bands between a column's extremes, closed on the right, the minimum in the first."""
    low, high = F.col("_low"), F.col("_high")
    edges = df.agg(F.min(as_col(value)).cast("double").alias("_low"), F.max(as_col(value)).cast("double").alias("_high"))
    # One row of extremes; a single-valued column sits in the middle of a slightly widened range.
    width = (high - low) / len(labels)
    band = F.when(F.col(value).isNull(), F.lit(None)).when(low == high, F.lit(labels[len(labels) // 2]))
    for i, label in enumerate(labels[:-1], start=1):
        band = band.when(F.col(value) <= low + width * i, F.lit(label))
    band = band.otherwise(F.lit(labels[-1]))
    return df.withColumn("_j", F.lit(1)).join(F.broadcast(edges.withColumn("_j", F.lit(1))), "_j").withColumn(output, band).drop("_j", "_low", "_high")
