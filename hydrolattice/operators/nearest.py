"""Exact nearest point by top-down refinement of a square lattice.

A query keeps the lattice cells that can still hold its nearest point, and each level replaces them by
their non-empty children. Work per query stays near-constant however many points there are, and every
step is an equi-join on a cell key; no query meets all points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col, nan_to_null

BROADCAST_CELLS = 65_536
_BRANCH = 4
_LEAF_POINTS = 64
_MAX_LEVELS = 12


def _squared(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def _box_bounds(x: Column, y: Column) -> tuple[Column, Column]:
    """Squared distance from a query to the nearest and farthest place of a cell's point box."""
    zero = F.lit(0.0)
    near = _squared(
        F.greatest(F.col("_x0") - x, x - F.col("_x1"), zero), F.greatest(F.col("_y0") - y, y - F.col("_y1"), zero)
    )
    far = _squared(
        F.greatest(F.abs(x - F.col("_x0")), F.abs(x - F.col("_x1"))), F.greatest(F.abs(y - F.col("_y0")), F.abs(y - F.col("_y1")))
    )
    return near, far


def _leaf(coordinate: Column, start: float, side: float, cells: int) -> Column:
    place = F.floor((coordinate - start) / side * cells)
    return F.least(F.greatest(place, F.lit(0)), F.lit(cells - 1))


def nearest_points(
    cells: DataFrame,
    points: DataFrame,
    *,
    cell_id: str = "cell_id",
    cell_x: str = "centroid_lon",
    cell_y: str = "centroid_lat",
    point_id: str = "weather_point_id",
    point_x: str = "longitude",
    point_y: str = "latitude",
    geographic: bool = True,
) -> DataFrame:
    """(cell_id, point_id): the nearest point of each cell; equal distances go to the lowest id.

    ``geographic`` scales x by the cosine of the points' mean y. ``cell_id`` must be unique. A point without both
    coordinates is no point; a cell without both has a missing point.
    """
    points = points.select(F.col(point_id), *[nan_to_null(F.col(c).cast("double")).alias(c) for c in (point_x, point_y)]).dropna()
    stats = points.agg(
        F.count(F.lit(1)).alias("n"), F.avg(point_y).alias("lat"),
        F.min(point_x).alias("x0"), F.max(point_x).alias("x1"), F.min(point_y).alias("y0"), F.max(point_y).alias("y1"),
    ).first()
    if not stats["n"]:
        raise ValueError("there are no points to assign")
    scale = math.cos(math.radians(stats["lat"])) if geographic else 1.0
    every = cells.select(
        F.col(cell_id), nan_to_null(as_col(cell_x).cast("double") * scale).alias("_x"), nan_to_null(as_col(cell_y).cast("double")).alias("_y")
    )
    placeless = F.col("_x").isNull() | F.col("_y").isNull()
    queries = every.filter(~placeless)
    sites = points.groupBy(
        (as_col(point_x).cast("double") * scale).alias("_px"), as_col(point_y).cast("double").alias("_py")
    ).agg(F.min(point_id).alias(point_id))

    x0, y0 = stats["x0"] * scale, float(stats["y0"])
    side = max(stats["x1"] * scale - x0, stats["y1"] - y0) or 1.0
    levels = max(1, math.ceil(math.log(stats["n"]) / (2 * math.log(_BRANCH))))

    def placed(rows: DataFrame, depth: int) -> DataFrame:
        across = _BRANCH**depth
        return rows.withColumn("_cx", _leaf(F.col("_px"), x0, side, across)).withColumn("_cy", _leaf(F.col("_py"), y0, side, across))

    # The fullest cell of every depth from one histogram at the deepest one.
    fine = placed(sites, _MAX_LEVELS).groupBy("_cx", "_cy").agg(F.count("*").alias("_n"))
    at = F.explode(F.sequence(F.lit(levels), F.lit(_MAX_LEVELS))).alias("_depth")
    shrunk = F.pow(F.lit(_BRANCH), F.lit(_MAX_LEVELS) - F.col("_depth"))
    per_cell = fine.select("*", at).groupBy("_depth", F.floor(F.col("_cx") / shrunk), F.floor(F.col("_cy") / shrunk)).agg(F.sum("_n").alias("_n"))
    fullest = {r["_depth"]: r["_n"] for r in per_cell.groupBy("_depth").agg(F.max("_n").alias("_n")).collect()}
    levels = next((d for d in range(levels, _MAX_LEVELS) if fullest[d] <= _LEAF_POINTS), _MAX_LEVELS)

    leaves = placed(sites, levels)
    boxes = leaves.groupBy("_cx", "_cy").agg(
        F.min("_px").alias("_x0"), F.max("_px").alias("_x1"), F.min("_py").alias("_y0"), F.max("_py").alias("_y1")
    )
    root = F.array(F.struct(F.lit(0).cast("long").alias("_cx"), F.lit(0).cast("long").alias("_cy")))
    state = queries.withColumn("_keep", root)
    near, far = _box_bounds(F.col("_x"), F.col("_y"))
    for level in range(1, levels + 1):
        shrink = _BRANCH ** (levels - level)
        table = boxes.groupBy(
            F.floor(F.col("_cx") / shrink).alias("_cx"), F.floor(F.col("_cy") / shrink).alias("_cy")
        ).agg(F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1"), F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1"))
        table = table.withColumns({"_ux": F.floor(F.col("_cx") / _BRANCH), "_uy": F.floor(F.col("_cy") / _BRANCH)})
        if _BRANCH ** (2 * level) <= BROADCAST_CELLS:
            table = F.broadcast(table)  # a level holds at most _BRANCH ** (2 * level) cells
        open_cells = state.select(cell_id, "_x", "_y", F.inline("_keep").alias("_ux", "_uy"))
        state = (
            open_cells.join(table, ["_ux", "_uy"])
            .select(cell_id, "_x", "_y", "_cx", "_cy", near.alias("_near"), far.alias("_far"))
            .groupBy(cell_id, "_x", "_y")
            .agg(F.min("_far").alias("_limit"), F.collect_list(F.struct("_near", "_cx", "_cy")).alias("_seen"))
            .select(
                cell_id, "_x", "_y",
                F.transform(
                    F.filter("_seen", lambda s: s["_near"] <= F.col("_limit") * (1 + 1e-9)),
                    lambda s: F.struct(s["_cx"].alias("_cx"), s["_cy"].alias("_cy")),
                ).alias("_keep"),
            )
        )
    distance = _squared(F.col("_x") - F.col("_px"), F.col("_y") - F.col("_py"))
    found = (
        state.select(cell_id, "_x", "_y", F.inline("_keep").alias("_cx", "_cy"))
        .join(leaves, ["_cx", "_cy"])
        .groupBy(cell_id)
        .agg(F.min(F.struct(distance.alias("d"), F.col(point_id).alias("id"))).alias("_best"))
        .select(cell_id, F.col("_best.id").alias(point_id))
    )
    return found.unionByName(every.filter(placeless).select(cell_id, F.lit(None).cast(found.schema[point_id].dataType).alias(point_id)))
