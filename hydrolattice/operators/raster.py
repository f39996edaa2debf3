"""Pixel tables: clipping, resampling, indices and zonal statistics.

A pixel table has one row per (scene, row, col); a scene's upper-left corner and pixel size place it in
the grid's metric coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spectral
from ..functions.numeric import as_col, round_even
from ..settings import REFLECTANCE_BANDS, Scenes


def clip_window(pixels: DataFrame, row_from, row_to, col_from, col_to, *, row: str = "row", col: str = "col") -> DataFrame:
    """Rows and columns of a half-open window; a plain range filter, so it reaches the scan."""
    return pixels.filter(
        (F.col(row) >= as_col(row_from)) & (F.col(row) < as_col(row_to)) & (F.col(col) >= as_col(col_from)) & (F.col(col) < as_col(col_to))
    )


def window_of(minx, miny, maxx, maxy, origin_x, origin_y, pixel: float, *, rounded: bool = False) -> dict[str, Column]:
    """Pixel window of a box below and right of an origin: outward floor/ceil, or rounded offset and length."""
    left, top = (as_col(minx) - as_col(origin_x)) / pixel, (as_col(origin_y) - as_col(maxy)) / pixel
    wide, tall = (as_col(maxx) - as_col(minx)) / pixel, (as_col(maxy) - as_col(miny)) / pixel
    if rounded:
        col_from, row_from = F.floor(left + 1e-3), F.floor(top + 1e-3)
        return {"col_from": col_from, "col_to": col_from + F.ceil(wide - 1e-3), "row_from": row_from, "row_to": row_from + F.ceil(tall - 1e-3)}
    return {"col_from": F.floor(left), "col_to": F.ceil(left + wide), "row_from": F.floor(top), "row_to": F.ceil(top + tall)}


def boxes_overlap(a: Sequence, b: Sequence) -> Column:
    """Open overlap of two (minx, miny, maxx, maxy) boxes: touching edges do not count."""
    a, b = [as_col(v) for v in a], [as_col(v) for v in b]
    return (a[2] > b[0]) & (a[0] < b[2]) & (a[3] > b[1]) & (a[1] < b[3])


def resample_nearest(coarse: DataFrame, *, factor: int = 2, row: str = "row", col: str = "col") -> DataFrame:
    """Repeat each coarse pixel over its factor x factor fine pixels."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    return (
        coarse.withColumn("_dr", F.explode(steps))
        .withColumn("_dc", F.explode(steps))
        .withColumns({row: F.col(row) * factor + F.col("_dr"), col: F.col(col) * factor + F.col("_dc")})
        .drop("_dr", "_dc")
    )


def align_nearest(fine: DataFrame, coarse: DataFrame, values: Sequence[str], *, scene: Sequence[str] = ("scene_id",), factor: int = 2, row: str = "row", col: str = "col") -> DataFrame:
    """Give each fine pixel the values of the coarse pixel over it, by an equi-join on the coarse position."""
    keyed = fine.withColumns({"_r": F.floor(F.col(row) / factor), "_c": F.floor(F.col(col) / factor)})
    side = coarse.select(*scene, F.col(row).cast("long").alias("_r"), F.col(col).cast("long").alias("_c"), *values)
    return keyed.join(side, [*scene, "_r", "_c"], "left").drop("_r", "_c")


def resample_bilinear(coarse: DataFrame, values: Sequence[str], *, scene: Sequence[str] = ("scene_id",), row: str = "row", col: str = "col") -> DataFrame:
    """Bilinear doubling of the resolution, weights renormalised where a neighbour is missing.

    Separable: neighbours along the row first, then along the column. Each pass is one shuffle of the coarse
    pixels, and a window partition is one raster line of one scene.
    """
    def pass_along(df: DataFrame, names: Sequence[str], fixed: str, moving: str, tags: tuple[str, str]) -> DataFrame:
        line = Window.partitionBy(*scene, fixed).orderBy(moving)
        prior = F.lag(moving).over(line) == F.col(moving) - 1
        later = F.lead(moving).over(line) == F.col(moving) + 1
        out = []
        for n in names:
            v = F.col(n)
            for tag, beside, there in ((tags[0], F.lag(n).over(line), prior), (tags[1], F.lead(n).over(line), later)):
                usable = F.coalesce(there, F.lit(False)) & beside.isNotNull()
                out.append(F.when(usable, v * 0.75 + beside * 0.25).otherwise(v).alias(f"{n}{tag}"))
        return df.select(*scene, row, col, *out)

    base = coarse.select(*scene, row, col, *[F.col(v).cast("double").alias(v) for v in values])
    across = pass_along(base, values, row, col, ("_l", "_r"))
    both = pass_along(across, [f"{v}{t}" for v in values for t in ("_l", "_r")], col, row, ("_t", "_b"))
    corners = F.array(*[
        F.struct(
            (F.col(row) * 2 + dr).alias(row), (F.col(col) * 2 + dc).alias(col),
            *[F.col(f"{v}{'_l' if dc == 0 else '_r'}{'_t' if dr == 0 else '_b'}").alias(v) for v in values],
        )
        for dr in (0, 1) for dc in (0, 1)
    ])
    return both.select(*scene, F.inline(corners))


def with_indices(pixels: DataFrame, *, scene_class: str = "scl", bands: Sequence[str] = REFLECTANCE_BANDS, offset=None) -> DataFrame:
    """Offset-corrected bands, the clear flag and the three indices."""
    if offset is not None:
        pixels = pixels.withColumns({b: spectral.remove_offset(b, offset) for b in bands})
    clear = spectral.is_clear(scene_class)
    return pixels.withColumns({
        "clear": clear,
        "ndvi": spectral.ndvi("b04", "b08", clear),
        "ndwi": spectral.ndwi("b08", "b11", clear),
        "evi": spectral.evi("b02", "b04", "b08", clear),
    })


def pixel_cells(
    pixels: DataFrame,
    *,
    origin_x=0.0,
    origin_y=0.0,
    pixel: float = 10.0,
    grid_x: float = 0.0,
    grid_y: float = 0.0,
    cell: float = 250.0,
    row: str = "row",
    col: str = "col",
) -> DataFrame:
    """Pair every pixel with the cells (ix, iy) its square overlaps: one when edges line up, up to four when not."""
    left = (as_col(origin_x) + F.col(col) * pixel - grid_x) / cell
    right = (as_col(origin_x) + (F.col(col) + 1) * pixel - grid_x) / cell
    low = (as_col(origin_y) - (F.col(row) + 1) * pixel - grid_y) / cell
    high = (as_col(origin_y) - F.col(row) * pixel - grid_y) / cell
    return pixels.withColumn("ix", F.explode(F.sequence(F.floor(left), F.ceil(right) - 1))).withColumn(
        "iy", F.explode(F.sequence(F.floor(low), F.ceil(high) - 1))
    )


def zonal_statistics(paired: DataFrame, *, keys: Sequence[str], bands: Sequence[str] = REFLECTANCE_BANDS, min_clear: int = Scenes().min_clear_pixels) -> DataFrame:
    """Clear share, index means and population deviations, and band means over the clear pixels of each key.

    ``paired`` holds ``clear``, the three indices and the bands. Aggregates are all partial, so a hot cell
    reaches its reducer as one row per map task.
    """
    clear = F.col("clear")
    indices = []
    for name in ("ndvi", "ndwi", "evi"):
        indices += [
            round_even(F.avg(F.when(clear, F.col(name))), 4).alias(f"{name}_mean"),
            round_even(F.stddev_pop(F.when(clear, F.col(name))), 4).alias(f"{name}_std"),
        ]
    return (
        paired.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_pixels"),
            F.count_if(clear).alias("_clear"),
            *indices,
            *[round_even(F.avg(F.when(clear, F.col(b))), 1).alias(f"{b}_mean") for b in bands],
        )
        .filter(F.col("_clear") >= min_clear)
        .withColumn("valid_pixel_pct", round_even(F.col("_clear") / F.col("_pixels") * 100, 2))
        .drop("_pixels", "_clear")
    )


def raw_pixels(fine: DataFrame, coarse: DataFrame, scenes: DataFrame, *, scene: Sequence[str] = ("scene_id", "date"), key: str = "scene_id", baseline: str = "baseline") -> DataFrame:
    """Raw band values of a scene as 10 m pixels with all bands, the scene class and the scene's offset.

    ``fine`` holds the 10 m bands; of ``coarse``, the 20 m bands are resampled bilinearly and the scene class is repeated.
    Resampling comes before the offset, which follows from the processing baseline of each scene; a scene without one fails.
    """
    sharp = resample_bilinear(coarse, ["b11", "b12"], scene=scene)
    wide = align_nearest(fine.join(sharp, [*scene, "row", "col"], "left"), coarse, ["scl"], scene=scene)
    offsets = scenes.select(key, F.col(baseline).alias("_baseline"))
    return wide.join(offsets, key, "left").withColumn("offset", spectral.baseline_offset("_baseline")).drop("_baseline")


def scene_features(pixels: DataFrame, cells: DataFrame, *, offset: str | None = None, area: str = "area_id", **placement) -> DataFrame:
    """Per (cell, scene) features: pixels are reduced by lattice position first and meet the cell table after.

    ``offset`` names the column with each pixel's offset; without it the bands count as corrected. Pixels that carry an
    ``area`` meet the cells of that area only.
    """
    own = [area] if area in pixels.columns and area in cells.columns else []
    corrected = with_indices(pixels, offset=None if offset is None else F.col(offset))
    stats = zonal_statistics(pixel_cells(corrected, **placement), keys=("scene_id", "date", *own, "ix", "iy"))
    return stats.join(cells.select(*own, "cell_id", "ix", "iy", "centroid_lon", "centroid_lat"), [*own, "ix", "iy"]).drop(*own, "ix", "iy")


def merge_overlaps(features: DataFrame, *, keys: Sequence[str] = ("cell_id", "date"), scene: str = "scene_id") -> DataFrame:
    """Plain mean of every other column over the scenes of a key; the scene kept is the first by name."""
    values = [c for c in features.columns if c not in (*keys, scene)]
    return features.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.min(scene).alias(scene))
