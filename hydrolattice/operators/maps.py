"""Advisories for scored cells, map layers, stride samples and cell lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import advice
from .ordering import ranked


def with_priority(scored: DataFrame, *, stress: str = "stress_code", ndwi: str = "ndwi_mean", temp: str = "temp_max_c", et0: str = "et0_8day_sum", rain: str = "rainfall_8day") -> DataFrame:
    """Rule number, priority and colour per scored row; no text."""
    return scored.withColumn("rule", advice.rule(stress, ndwi, temp, et0, rain)).withColumns({
        "priority": advice.priority("rule"), "color": advice.colour("rule"),
    })


def with_advisory(scored: DataFrame, *, stress: str = "stress_code", confidence: str = "confidence", ndwi: str = "ndwi_mean", temp: str = "temp_max_c", et0: str = "et0_8day_sum", rain: str = "rainfall_8day") -> DataFrame:
    return scored.withColumn("advisory", advice.advisory(stress, confidence, ndwi, temp, et0, rain))


def stride_sample(df: DataFrame, *, when: str = "date", order: str = "cell_id", limit: int = 1500, sample: bool = True, **options) -> DataFrame:
    """Every step-th row of each date, first ``limit`` of them, step = max(1, rows div limit).

    A limit of 0, ``sample=False`` or a date with no more rows than the limit keeps every row. ``order``
    must be unique within a date. Row numbers come from bucketed running counts, not one window per date.
    """
    numbered = ranked(df, [when], [order], "_at", "total_cells", **options)
    step = F.greatest(F.lit(1), F.floor(F.col("total_cells") / F.lit(max(limit, 1))))
    index = F.col("_at") - 1
    keep = (index % step == 0) & (index < step * limit)
    if not sample or limit <= 0:
        keep = F.lit(True)
    else:
        keep = keep | (F.col("total_cells") <= limit)
    return numbered.filter(keep).drop("_at")


def sample_metadata(sampled: DataFrame, when: str = "date") -> DataFrame:
    return sampled.groupBy(when).agg(F.max("total_cells").alias("total_cells"), F.count(F.lit(1)).alias("sampled_cells")).withColumn(
        "is_sampled", F.col("sampled_cells") < F.col("total_cells")
    )


# Columns a map layer reads, by what they hold.
LAYER_COLUMNS = {
    "stress": "stress_code", "confidence": "confidence", "ndvi": "ndvi_mean", "ndwi": "ndwi_mean",
    "temp": "temp_max_c", "et0": "et0_8day_sum", "rain": "rainfall_8day",
}


def map_layer(scored: DataFrame, geometry: DataFrame, *, layer: str = "stress", cell: str = "cell_id", when: str = "date", polygon: str = "geometry", **columns) -> DataFrame:
    """One GeoJSON feature per scored cell that has a geometry, as JSON text in ``value``."""
    n = LAYER_COLUMNS | columns
    joined = scored.join(geometry.select(cell, polygon), cell)
    common = (cell, when, n["stress"], n["confidence"], n["ndvi"], n["ndwi"])
    if layer == "stress":
        properties = advice.stress_properties(*common)
    else:
        properties = advice.irrigation_properties(*common, n["temp"], n["et0"], n["rain"])
    feature = F.struct(F.lit("Feature").alias("type"), F.col(polygon).alias("geometry"), properties.alias("properties"))
    return joined.select(cell, when, F.to_json(feature).alias("value"))


def box_geometry(minx, miny, maxx, maxy):
    """GeoJSON polygon of a box."""
    x0, y0, x1, y1 = (F.col(c) if isinstance(c, str) else c for c in (minx, miny, maxx, maxy))
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def cell_details(results: DataFrame, requests: DataFrame, *, keys: tuple[str, ...] = ("date", "cell_id"), language: str = "en") -> DataFrame:
    """Stress and irrigation details of the requested (date, cell) pairs, in one language."""
    found = results.join(requests.select(*keys).distinct(), list(keys))
    told = advice.advisory_in(language, "stress_code", "confidence", "ndwi_mean", "temp_max_c", "et0_8day_sum", "rainfall_8day")
    return found.withColumn("advisory", told)
