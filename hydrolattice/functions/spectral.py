"""Reflectance offsets, clear-pixel mask and vegetation indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import CLEAR_SCENE_CLASSES, Scenes
from .numeric import as_col, clip

_EPS = 1e-6
_FULL_SCALE = 10000.0


def remove_offset(band, offset) -> Column:
    return clip(as_col(band).cast("double") + as_col(offset), low=0.0)


def baseline_offset(baseline, scenes: Scenes = Scenes()) -> Column:
    """Offset that a processing baseline carries; an unknown baseline fails the query."""
    baseline = as_col(baseline)
    return (
        F.when(baseline.isNull(), F.raise_error(F.lit("processing baseline is missing, so the offset is unknown")).cast("double"))
        .when(baseline.cast("double") >= scenes.offset_from_baseline, F.lit(scenes.offset))
        .otherwise(F.lit(0.0))
    )


def is_clear(scene_class) -> Column:
    return F.coalesce(as_col(scene_class).isin(*CLEAR_SCENE_CLASSES), F.lit(False))


def _ratio(numerator: Column, denominator: Column, clear: Column, low: float, high: float) -> Column:
    return F.when(clear & (denominator > 0), clip(numerator / (denominator + _EPS), low, high))


def ndvi(red, nir, clear: Column) -> Column:
    r, n = as_col(red) / _FULL_SCALE, as_col(nir) / _FULL_SCALE
    return _ratio(n - r, n + r, clear, -1.0, 1.0)


def ndwi(nir, swir, clear: Column) -> Column:
    n, s = as_col(nir) / _FULL_SCALE, as_col(swir) / _FULL_SCALE
    return _ratio(n - s, n + s, clear, -1.0, 1.0)


def evi(blue, red, nir, clear: Column) -> Column:
    b, r, n = (as_col(c) / _FULL_SCALE for c in (blue, red, nir))
    return _ratio(F.lit(2.5) * (n - r), n + F.lit(6.0) * r - F.lit(7.5) * b + F.lit(1.0), clear, -1.0, 2.5)
